"""Domain constants shared by the whole package.

FIXED VALUES: everything in this module is a given of the freight domain (status names, carrier
codes, tolerances, templates, rate cards).  Results are only right if these stay as they are.
"""

# Shipment life cycle: status -> statuses it may move to.
TRANSITIONS = {
    "CREATED": ["CARRIER_ASSIGNED", "CANCELLED"],
    "CARRIER_ASSIGNED": ["PICKED_UP", "CANCELLED"],
    "PICKED_UP": ["IN_TRANSIT"],
    "IN_TRANSIT": ["OUT_FOR_DELIVERY", "EXCEPTION"],
    "OUT_FOR_DELIVERY": ["DELIVERED", "EXCEPTION"],
    "EXCEPTION": ["IN_TRANSIT", "OUT_FOR_DELIVERY", "CANCELLED"],
    "DELIVERED": [],
    "CANCELLED": [],
}
SHIPMENT_STATUSES = list(TRANSITIONS)
TERMINAL_STATUSES = ["DELIVERED", "CANCELLED"]
ACTIVE_DELIVERY_STATUSES = ["IN_TRANSIT", "OUT_FOR_DELIVERY"]
SCORED_STATUSES = ["DELIVERED", "IN_TRANSIT", "OUT_FOR_DELIVERY"]

INVOICE_STATUSES = [
    "RECEIVED", "OCR_PENDING", "OCR_COMPLETE", "MATCHING",
    "APPROVED", "DISPUTED", "PAID", "REJECTED",
]

# Carrier status code (upper case) -> shipment status.  Codes are upper-cased before the lookup,
# so a mixed-case spelling such as ON_FedEx_VEHICLE can never match and is left out on purpose.
CARRIER_STATUS_CODES = {
    "PICKED_UP": "PICKED_UP",
    "PACKAGE_RECEIVED": "PICKED_UP",
    "SHIPMENT_PICKED_UP": "PICKED_UP",
    "IN_TRANSIT": "IN_TRANSIT",
    "AT_FEDEX_FACILITY": "IN_TRANSIT",
    "DEPARTED_FACILITY": "IN_TRANSIT",
    "IN_TRANSIT_TO_DESTINATION": "IN_TRANSIT",
    "OUT_FOR_DELIVERY": "OUT_FOR_DELIVERY",
    "DELIVERED": "DELIVERED",
    "PACKAGE_DELIVERED": "DELIVERED",
    "DELIVERY_EXCEPTION": "EXCEPTION",
    "EXCEPTION": "EXCEPTION",
    "UNABLE_TO_DELIVER": "EXCEPTION",
}

# Carrier scorecard.
ON_TIME_WEIGHT = "0.6"
ACCURACY_WEIGHT = "0.4"
TIERS = [("90", "PREFERRED"), ("75", "STANDARD"), ("60", "WATCH")]
LOWEST_TIER = "REVIEW_REQUIRED"
DEFAULT_LOOKBACK_DAYS = 30

# Invoice matching.
DOLLAR_TOLERANCE = "5.00"
PERCENT_TOLERANCE = "2.0"
PAYMENT_TERMS_DAYS = 30
DEFAULT_CURRENCY = "USD"

# Queues: receives of a message before it is put aside.
MAX_RECEIVES = 3

# Reports, paging, retention, metrics.
REPORT_MIN_DAYS = 1
REPORT_MAX_DAYS = 365
DEFAULT_PAGE_SIZE = 20
MAX_PAGE_SIZE = 100
TRACKING_RETENTION_DAYS = 90
METRIC_STEP = "60 seconds"
ERROR_LOG_LINES = 50

# Documents.
CONTENT_TYPES_INDEXER = {
    "pdf": "application/pdf",
    "jpg": "image/jpeg",
    "jpeg": "image/jpeg",
    "png": "image/png",
    "tif": "image/tiff",
    "tiff": "image/tiff",
}
CONTENT_TYPES_UPLOAD = {
    "pdf": "application/pdf",
    "jpg": "image/jpeg",
    "jpeg": "image/jpeg",
    "png": "image/png",
}
DEFAULT_CONTENT_TYPE = "application/octet-stream"
INVOICE_PREFIX = "invoice/"
OCR_EXTENSIONS = r"\.(pdf|jpg|jpeg|png|tiff?)$"

# Messages.
ENVELOPE_MARK = '"Type":"Notification"'
TRACKING_EVENT = "TrackingEventReceivedEvent"
OCR_EVENT = "OcrJobStartedEvent"
RATE_EVENT = "CarrierRateUpdatedEvent"
UNKNOWN_CORRELATION = "unknown"

# Topic subscriptions: topic -> queue -> event types let through (None = all).
SUBSCRIPTIONS = {
    "shipment-events": {
        "notification-queue": None,
        "analytics-queue": None,
        "shipment-inbound-queue": [TRACKING_EVENT],
    },
    "invoice-events": {
        "notification-queue": None,
        "invoice-processing-queue": None,
    },
}

# Literal rate cards, used for carriers that delivered no rates of their own:
# carrier, lane, origin, destination, type, rate per cwt, fuel %, minimum, transit days.
RATE_CARDS = [
    ("fedex", "TX-CA-LTL", "TX", "CA", "LTL", "12.50", "18.5", "250.00", 3),
    ("fedex", "NY-FL-LTL", "NY", "FL", "LTL", "14.20", "18.5", "300.00", 2),
    ("fedex", "IL-TX-FTL", "IL", "TX", "FTL", "2.80", "22.0", "1200.00", 2),
    ("fedex", "CA-WA-LTL", "CA", "WA", "LTL", "10.50", "17.0", "200.00", 2),
    ("ups", "TX-CA-LTL", "TX", "CA", "LTL", "11.80", "17.2", "225.00", 4),
    ("ups", "NY-FL-LTL", "NY", "FL", "LTL", "13.60", "17.2", "275.00", 3),
    ("ups", "IL-TX-FTL", "IL", "TX", "FTL", "2.65", "20.0", "1100.00", 2),
    ("dhl", "TX-CA-LTL", "TX", "CA", "LTL", "13.10", "19.0", "260.00", 3),
    ("dhl", "NY-FL-LTL", "NY", "FL", "LTL", "14.80", "19.0", "310.00", 2),
]

# How match decisions are worded.
MISSING_REFERENCE_TEXT = "No matching shipment found for reference: "
RATE_NOT_FOUND_TEXT = "Could not find contracted rate for carrier "
MISSING_AMOUNT_TEXT = "Invoice has no amount"
WITHIN_TOLERANCE_TEXT = "Within tolerance (diff=$"
