"""Declared schemas.  Nothing in the package infers one."""

from __future__ import annotations

from pyspark.sql.types import StructType

CORRUPT = "_corrupt"
PARSE_OPTIONS = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}

FEDEX_PAYLOAD = f"""
    TrackingInfo struct<
        customerTrackingId: string, trackingNumber: string,
        latestStatus: struct<
            statusCode: string, description: string,
            scanLocation: struct<city: string, stateOrProvinceCode: string>>>,
    {CORRUPT} string"""
UPS_PAYLOAD = f"""
    shipment struct<
        referenceNumber: string,
        package: struct<
            trackingNumber: string,
            activity: array<struct<
                status: struct<type: string>, description: string,
                location: struct<address: struct<city: string, stateProvince: string>>>>>>,
    {CORRUPT} string"""
DHL_PAYLOAD = f"""
    shipmentTrackingNumber string, customerReference string,
    events array<struct<
        status: string, description: string,
        location: struct<address: struct<addressLocality: string, countryCode: string>>>>,
    {CORRUPT} string"""
GENERIC_PAYLOAD = f"""
    shipmentId string, trackingNumber string, status string, description string,
    location string, {CORRUPT} string"""

ENVELOPE = """
    Type string, MessageId string, TopicArn string, Subject string, Message string,
    MessageAttributes map<string, struct<Type: string, Value: string>>"""
OBJECT_NOTIFICATION = """
    Records array<struct<s3: struct<
        bucket: struct<name: string>, object: struct<key: string, size: bigint>>>>"""
TRACKING_MESSAGE = """
    shipmentId string, carrierTrackingNumber string, carrierStatus string,
    statusDescription string, location string, correlationId string, timestamp string"""
LOG_LINE = """
    `@timestamp` timestamp, level string, service string, environment string,
    correlationId string, userId string, traceId string, thread string, logger string,
    message string, shipmentId string, duration_ms bigint"""

SHIPMENTS = """
    shipment_id string NOT NULL, reference_no string NOT NULL,
    shipper_id string NOT NULL, shipper_name string NOT NULL, shipper_email string NOT NULL,
    consignee_id string, consignee_name string, consignee_email string,
    origin_street string, origin_city string NOT NULL, origin_state string NOT NULL,
    origin_zip string, origin_country string NOT NULL,
    dest_street string, dest_city string NOT NULL, dest_state string NOT NULL,
    dest_zip string, dest_country string NOT NULL,
    carrier_id string, carrier_name string, carrier_tracking_number string,
    carrier_rate_id string, negotiated_rate decimal(10,2),
    weight_lbs decimal(10,2), declared_value decimal(12,2), currency string NOT NULL,
    special_instructions string, gl_code string, status string NOT NULL,
    estimated_delivery timestamp, actual_delivery timestamp,
    pod_document_key string, recipient_name string,
    created_at timestamp NOT NULL, updated_at timestamp NOT NULL,
    created_by string, version bigint NOT NULL"""
SHIPMENT_LEGS = """
    id string NOT NULL, shipment_id string NOT NULL, sequence int NOT NULL,
    carrier_id string NOT NULL, carrier_name string,
    origin_city string NOT NULL, origin_state string NOT NULL,
    dest_city string NOT NULL, dest_state string NOT NULL,
    estimated_departure timestamp, actual_departure timestamp,
    estimated_arrival timestamp, actual_arrival timestamp, status string NOT NULL"""
INVOICES = """
    invoice_id string NOT NULL, invoice_number string NOT NULL, carrier_id string NOT NULL,
    carrier_name string, shipment_id string, shipment_reference_number string,
    invoice_date date, invoiced_amount decimal(12,2), expected_amount decimal(12,2),
    approved_amount decimal(12,2), currency string NOT NULL, gl_code string,
    status string NOT NULL, document_key string, ocr_job_id string, dispute_reason string,
    dispute_description string, payment_due_date date, paid_at timestamp,
    auto_approved boolean NOT NULL, approved_at timestamp, approved_by string,
    created_at timestamp NOT NULL, updated_at timestamp NOT NULL, version bigint NOT NULL"""
INVOICE_LINE_ITEMS = """
    id string NOT NULL, invoice_id string NOT NULL, description string NOT NULL,
    charge_type string, quantity decimal(10,4), unit_price decimal(10,4),
    total_amount decimal(12,2) NOT NULL, gl_code string"""
CARRIER_RATES = """
    carrier_id string NOT NULL, lane_id string NOT NULL, carrier_name string,
    origin_state string, dest_state string, shipment_type string,
    rate_per_cwt decimal(10,4), fuel_surcharge_percent decimal(10,4),
    minimum_charge decimal(10,4), transit_days int, effective_date date, expiration_date date,
    active boolean, last_refreshed_at timestamp"""
DOCUMENTS = """
    document_id string NOT NULL, shipment_id string, document_type string, s3_key string,
    s3_bucket string, file_name string, content_type string, file_size_bytes bigint,
    uploaded_by string, status string, uploaded_at timestamp, indexed_at timestamp,
    description string"""


def struct(ddl: str) -> StructType:
    """A schema string as a StructType."""
    return StructType.fromDDL(ddl)
