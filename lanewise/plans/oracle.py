"""ANSI SQL for the catalogue's queries, written independently of the operators.

Runs on the raw test tables.  ``VIEWS`` restates the sample tables; a query names those it needs.
"""

from __future__ import annotations

from lanewise.plans import catalogue, live

SECONDS_PER_DAY = 86400

VIEWS = {
    "shipments": ("", """
        SELECT cast(o.o_orderkey AS varchar) AS shipment_id, o.o_orderkey AS k,
               concat('REF-', lpad(cast(o.o_orderkey AS varchar), 8, '0')) AS reference_no,
               cast(o.o_custkey AS varchar) AS shipper_id, c.c_name AS shipper_name,
               concat(lower(replace(c.c_name, '#', '.')), '@example.com') AS shipper_email,
               concat('Consignee ', o.o_custkey % 97) AS consignee_name,
               CASE WHEN o.o_custkey % 7 = 0 THEN NULL WHEN o.o_custkey % 11 = 0 THEN '  '
                    ELSE concat('dock', o.o_custkey, '@example.org') END AS consignee_email,
               cast(s.s_suppkey AS varchar) AS carrier_id, s.s_suppkey, s.s_name AS carrier_name,
               concat('TRK', o.o_orderkey) AS carrier_tracking_number,
               concat(sn.n_name, ' City') AS origin_city, sn.n_name AS origin_state,
               concat(cn.n_name, ' Town') AS dest_city, cn.n_name AS dest_state,
               CASE o.o_orderkey % 3 WHEN 0 THEN 'LTL' WHEN 1 THEN 'FTL' ELSE 'PARCEL' END
                   AS shipment_type,
               CASE WHEN o.o_orderkey % 50 <> 0
                    THEN cast(o.o_orderkey % 997 + 100 AS decimal(10,2)) END AS weight_lbs,
               cast(o.o_totalprice AS decimal(12,2)) AS negotiated_rate,
               cast(o.o_totalprice AS decimal(12,2)) AS declared_value,
               concat('GL-', substr(o.o_orderpriority, 1, 1)) AS gl_code, o.status, o.created_at,
               o.created_at AS updated_at, o.estimated_delivery,
               CASE WHEN o.status = 'DELIVERED' THEN o.estimated_delivery + interval 1 hour *
                   (CASE WHEN o.o_custkey % 10 < (s.s_suppkey % 4) * 2
                         THEN 24 * (1 + o.o_custkey % 3)
                         WHEN o.o_custkey % 10 = 9 THEN 1 ELSE -30 END) END AS actual_delivery
        FROM (SELECT *, created_at + interval 1 day * (3 + o_orderkey % 5) AS estimated_delivery
              FROM (SELECT *, o_orderdate + interval 1 hour * (o_orderkey % 24) AS created_at,
                           CASE WHEN o_orderstatus = 'F' THEN 'DELIVERED'
                                WHEN o_orderstatus = 'O' AND o_custkey % 20 = 0 THEN 'IN_TRANSIT'
                                WHEN o_orderstatus = 'O' AND o_custkey % 20 = 7
                                    THEN 'OUT_FOR_DELIVERY'
                                WHEN o_orderstatus = 'O' THEN 'DELIVERED'
                                WHEN o_custkey % 2 = 0 THEN 'CREATED' ELSE 'CANCELLED' END
                               AS status
                    FROM orders)) o
        JOIN supplier s ON s.s_suppkey = o.o_orderkey % (SELECT count(*) FROM supplier)
        JOIN nation sn ON sn.n_nationkey = s.s_nationkey
        JOIN customer c ON c.c_custkey = o.o_custkey
        JOIN nation cn ON cn.n_nationkey = c.c_nationkey"""),
    "invoices": ("shipments", """
        SELECT invoice_id, concat('INV-', invoice_id) AS invoice_number, shipment_id,
               reference_no AS shipment_reference_number, carrier_id, carrier_name, invoice_date,
               invoiced_amount, expected_amount,
               CASE WHEN status IN ('APPROVED', 'PAID') THEN expected_amount END
                   AS approved_amount,
               'USD' AS currency, gl_code, status,
               status = 'APPROVED' AND k % 2 = 0 AS auto_approved,
               cast(invoice_date + interval 30 day AS date) AS payment_due_date,
               CASE WHEN status = 'PAID' THEN created_at + interval 45 day END AS paid_at,
               created_at
        FROM (SELECT s.* EXCLUDE (status),
                     concat(s.shipment_id, '-', l.l_linenumber) AS invoice_id,
                     l.invoice_date, l.invoiced_amount,
                     cast(CASE l.lk % 5
                          WHEN 0 THEN l.invoiced_amount WHEN 1 THEN l.invoiced_amount - 4.50
                          WHEN 2 THEN l.invoiced_amount * 1.01
                          WHEN 3 THEN l.invoiced_amount *
                              (CASE WHEN l.lk % 2 = 0 THEN 0.90 ELSE 1.10 END)
                          END AS decimal(12,2)) AS expected_amount,
                     CASE WHEN l.flag = 'R' AND s.s_suppkey % 3 = 0 THEN 'DISPUTED'
                          WHEN l.flag = 'R' THEN 'PAID' WHEN l.flag = 'A' THEN 'APPROVED'
                          ELSE 'RECEIVED' END AS status
              FROM (SELECT l_orderkey AS lk, l_linenumber, max(l_returnflag) AS flag,
                           cast(min(l_shipdate) AS date) AS invoice_date,
                           cast(sum(cast(l_extendedprice AS decimal(12,2))) AS decimal(12,2))
                               AS invoiced_amount
                    FROM lineitem GROUP BY l_orderkey, l_linenumber) l
              JOIN shipments s ON s.k = l.lk)"""),
    "rates": ("", """
        SELECT cast(s.s_suppkey AS varchar) AS carrier_id, s.s_name AS carrier_name,
               concat(o.n_name, '-', d.n_name, '-', t.shipment_type) AS lane_id,
               o.n_name AS origin_state, d.n_name AS dest_state, t.shipment_type,
               cast(5 + (s.s_suppkey * 7 + d.n_nationkey) % 11 AS decimal(10,2)) AS rate_per_cwt,
               cast(15 + s.s_suppkey % 8 AS decimal(5,2)) AS fuel_surcharge_percent,
               CASE WHEN s.s_suppkey % 9 <> 0
                    THEN cast(20 + s.s_suppkey % 30 AS decimal(10,2)) END AS minimum_charge,
               cast(1 + (s.s_suppkey + d.n_nationkey) % 6 AS int) AS transit_days,
               s.s_suppkey % 10 <> 0 AS active
        FROM supplier s JOIN nation o ON o.n_nationkey = s.s_nationkey
        CROSS JOIN nation d
        CROSS JOIN (VALUES ('LTL'), ('FTL'), ('PARCEL')) t(shipment_type)"""),
    "tracking": ("", """
        SELECT event_id, ts, cast(user_id AS varchar) AS shipment_id,
               CASE event_type WHEN 'signup' THEN 'PACKAGE_RECEIVED'
                    WHEN 'view' THEN 'DEPARTED_FACILITY' WHEN 'click' THEN 'out_for_delivery'
                    WHEN 'purchase' THEN 'DELIVERED'
                    ELSE CASE WHEN event_id % 4 = 0 THEN 'LABEL_PRINTED'
                              ELSE 'UNABLE_TO_DELIVER' END END AS carrier_status,
               CASE event_type WHEN 'signup' THEN 'PICKED_UP' WHEN 'view' THEN 'IN_TRANSIT'
                    WHEN 'click' THEN 'OUT_FOR_DELIVERY' WHEN 'purchase' THEN 'DELIVERED'
                    ELSE CASE WHEN event_id % 4 <> 0 THEN 'EXCEPTION' END END AS wanted,
               concat('value ', cast(floor(value) AS bigint)) AS status_reason,
               concat('Hub ', event_id % 50) AS location
        FROM events"""),
    "incoming": ("", """
        SELECT concat('INV-', l_orderkey, '-', l_linenumber) AS invoice_number,
               concat(l_orderkey, '-', l_linenumber) AS invoice_id,
               cast(l_suppkey AS varchar) AS carrier_id,
               cast(l_shipdate AS date) AS invoice_date,
               cast(l_extendedprice AS decimal(12,2)) AS invoiced_amount,
               CASE WHEN l_suppkey % 3 = 0 THEN 'CAD' END AS currency,
               concat('GL-', l_linestatus) AS gl_code, l_shipdate AS received_at,
               l_returnflag AS batch, concat('Part ', l_partkey) AS description,
               CASE l_suppkey % 4 WHEN 0 THEN 'BASE_FREIGHT' WHEN 1 THEN 'FUEL_SURCHARGE'
                    WHEN 2 THEN 'ACCESSORIAL' ELSE 'RESIDENTIAL_DELIVERY' END AS charge_type,
               cast(l_quantity AS decimal(10,4)) AS quantity,
               cast(100 + l_partkey % 900 AS decimal(10,4)) AS unit_price
        FROM lineitem"""),
    "legs": ("", """
        SELECT cast(l_orderkey AS varchar) AS shipment_id, l_linenumber AS sequence,
               min(l_suppkey) AS suppkey
        FROM lineitem GROUP BY l_orderkey, l_linenumber"""),
    "history": ("shipments", """
        SELECT carrier_id, concat(origin_state, '-', dest_state, '-', shipment_type) AS lane_id,
               negotiated_rate AS rate, created_at AS refreshed_at, k AS refresh_id
        FROM shipments"""),
    "objects": ("", """
        SELECT doc_id, s3_bucket, file_size_bytes, kind, ending,
               CASE WHEN short THEN concat(kind, '/doc', doc_id)
                    ELSE concat(kind, '/ship ', doc_id % 100, '/doc ', doc_id, ending) END
                   AS s3_key,
               short
        FROM (SELECT doc_id, concat('docs-', lang) AS s3_bucket, doc_id % 13 = 0 AS short,
                     CASE WHEN doc_id % 9 <> 0 THEN n_chars ELSE 0 END AS file_size_bytes,
                     CASE doc_id % 4 WHEN 0 THEN 'invoice' WHEN 1 THEN 'Invoice' WHEN 2 THEN 'pod'
                          ELSE 'bill_of_lading' END AS kind,
                     CASE doc_id % 6 WHEN 0 THEN '.pdf' WHEN 1 THEN '.PDF' WHEN 2 THEN '.tiff'
                          WHEN 3 THEN '.tar.gz' WHEN 4 THEN '' ELSE '.jpeg' END AS ending
              FROM documents)"""),
    "parsed": ("objects", """
        SELECT doc_id, s3_bucket, s3_key, file_size_bytes, ending,
               CASE WHEN short THEN 'SKIPPED' ELSE 'INDEXED' END AS outcome,
               CASE WHEN NOT short THEN concat('doc ', doc_id, ending) END AS file_name,
               CASE WHEN NOT short THEN upper(kind) END AS document_type,
               CASE WHEN NOT short THEN concat('ship ', doc_id % 100) END AS shipment_id,
               CASE WHEN NOT short THEN concat('doc ', doc_id,
                    CASE WHEN ending = '.tar.gz' THEN '.tar' ELSE '' END) END AS document_id,
               CASE WHEN short THEN '' WHEN ending = '.tar.gz' THEN 'gz'
                    ELSE replace(ending, '.', '') END AS extension,
               CASE WHEN short THEN NULL
                    WHEN ending IN ('.pdf', '.PDF') THEN 'application/pdf'
                    WHEN ending = '.tiff' THEN 'image/tiff' WHEN ending = '.jpeg' THEN 'image/jpeg'
                    ELSE 'application/octet-stream' END AS content_type
        FROM objects"""),
    "metadata": ("", """
        SELECT concat('doc ', doc_id) AS document_id, 'old-shipment' AS shipment_id,
               'UNKNOWN' AS document_type, concat('user', doc_id % 10) AS uploaded_by,
               'UPLOADED' AS status, concat('uploaded from ', source) AS description
        FROM documents WHERE doc_id % 2 = 0"""),
    "indexed": ("parsed metadata", """
        SELECT coalesce(m.document_id, p.document_id) AS document_id,
               CASE WHEN p.document_id IS NULL THEN m.shipment_id ELSE p.shipment_id END
                   AS shipment_id,
               CASE WHEN p.document_id IS NULL THEN m.document_type ELSE p.document_type END
                   AS document_type,
               m.uploaded_by,
               CASE WHEN p.document_id IS NULL THEN m.status ELSE 'INDEXED' END AS status,
               m.description, p.s3_key, p.s3_bucket, p.file_name, p.content_type,
               p.file_size_bytes,
               CASE WHEN p.document_id IS NOT NULL THEN timestamp '2024-03-10 00:00:00' END
                   AS indexed_at
        FROM metadata m
        FULL JOIN (SELECT * FROM parsed WHERE outcome = 'INDEXED') p
               ON p.document_id = m.document_id"""),
    "ocr": ("objects", """
        SELECT doc_id, s3_bucket, s3_key,
               CASE WHEN NOT short AND lower(kind) = 'invoice'
                         AND ending IN ('.pdf', '.PDF', '.tiff', '.jpeg')
                    THEN 'STARTED' ELSE 'SKIPPED' END AS ocr_outcome,
               concat('ship ', doc_id % 100) AS shipment_id, concat('doc ', doc_id) AS document_id
        FROM objects"""),
    "webhooks": ("tracking", """
        SELECT event_id,
               CASE WHEN event_id % 59 = 0 THEN 'unknown' ELSE
                   CASE event_id % 4 WHEN 0 THEN 'fedex' WHEN 1 THEN 'UPS' WHEN 2 THEN 'dhl'
                        ELSE 'acme' END END AS carrier_id,
               shipment_id AS sid, carrier_status AS code, status_reason, location AS hub,
               CASE WHEN event_id % 5 <> 0 THEN concat('City ', event_id % 9) ELSE '' END AS city,
               CASE WHEN event_id % 41 = 0 OR event_id % 43 = 0 THEN 'EMPTY_BODY'
                    WHEN event_id % 53 = 0 AND event_id % 4 IN (0, 1) AND event_id % 59 <> 0
                        THEN 'INVALID_SIGNATURE'
                    WHEN event_id % 37 = 0 THEN 'INVALID_JSON' WHEN event_id % 47 = 0 THEN 'ERROR'
                    ELSE 'OK' END AS outcome
        FROM tracking"""),
    "normalised": ("webhooks", """
        SELECT event_id, carrier_id, outcome,
               CASE WHEN outcome <> 'OK' THEN NULL
                    WHEN lower(carrier_id) <> CASE event_id % 4 WHEN 0 THEN 'fedex'
                         WHEN 1 THEN 'ups' WHEN 2 THEN 'dhl' ELSE lower(carrier_id) END THEN ''
                    WHEN event_id % 4 = 2 AND event_id % 3 <> 0 THEN concat('T', event_id)
                    ELSE sid END AS shipment_id,
               CASE WHEN outcome <> 'OK' THEN NULL
                    WHEN lower(carrier_id) = 'unknown' AND event_id % 4 <> 3 THEN ''
                    ELSE concat('T', event_id) END AS carrier_tracking_number,
               CASE WHEN outcome <> 'OK' THEN NULL
                    WHEN lower(carrier_id) = 'unknown' AND event_id % 4 <> 3 THEN ''
                    WHEN event_id % 4 = 1 AND event_id % 6 = 1 THEN ''
                    ELSE code END AS carrier_status,
               CASE WHEN outcome <> 'OK' THEN NULL
                    WHEN lower(carrier_id) = 'unknown' THEN ''
                    WHEN event_id % 4 = 3 THEN ''
                    WHEN event_id % 4 = 1 AND event_id % 6 = 1 THEN ''
                    ELSE status_reason END AS status_description,
               CASE WHEN outcome <> 'OK' THEN NULL
                    WHEN lower(carrier_id) = 'unknown' AND event_id % 4 <> 3 THEN ''
                    WHEN event_id % 4 = 3 THEN hub
                    WHEN event_id % 4 = 2 THEN ', '
                    WHEN event_id % 4 = 1 AND event_id % 6 = 1 THEN ', '
                    WHEN event_id % 4 = 1 THEN concat(city, ', CA')
                    ELSE concat(city, ', TX') END AS location
        FROM webhooks"""),
    "queue": ("tracking", """
        SELECT event_id, ts, shipment_id, event_id % 67 <> 0 AS readable,
               CASE WHEN event_id % 67 = 0 OR event_id % 19 = 0 THEN '' ELSE
                   CASE event_id % 8 WHEN 0 THEN 'ShipmentCreatedEvent'
                        WHEN 1 THEN 'ShipmentStatusChangedEvent'
                        WHEN 2 THEN 'ShipmentDeliveredEvent' WHEN 3 THEN 'InvoiceApprovedEvent'
                        WHEN 4 THEN 'InvoiceDisputedEvent' WHEN 5 THEN 'CarrierRateUpdatedEvent'
                        WHEN 6 THEN 'TrackingEventReceivedEvent' ELSE 'CarrierAssignedEvent' END
                   END AS body_event_type,
               CASE WHEN event_id % 2 = 0 THEN 'IN_TRANSIT'
                    WHEN event_id % 9 = 0 THEN 'OUT_FOR_DELIVERY' ELSE 'PICKED_UP' END
                   AS new_status,
               CASE WHEN event_id % 3 <> 0 AND event_id % 5 <> 0
                    THEN concat('a', event_id, '@example.com') END AS mail,
               CASE WHEN event_id % 4 <> 0 THEN 'team@example.org' END AS other_mail,
               CASE WHEN event_id % 16 = 0 THEN 'Fast Freight' END AS carrier_name
        FROM tracking"""),
    "mails": ("queue", """
        SELECT event_id, ts, body_event_type AS kind,
               CASE body_event_type WHEN 'ShipmentCreatedEvent' THEN 'shipment-created'
                    WHEN 'ShipmentStatusChangedEvent' THEN
                        CASE new_status WHEN 'IN_TRANSIT' THEN 'shipment-in-transit'
                             ELSE 'shipment-out-for-delivery' END
                    WHEN 'ShipmentDeliveredEvent' THEN 'shipment-delivered'
                    WHEN 'InvoiceApprovedEvent' THEN 'invoice-approved'
                    WHEN 'InvoiceDisputedEvent' THEN 'invoice-disputed'
                    ELSE 'carrier-rate-updated' END AS template,
               CASE body_event_type
                    WHEN 'ShipmentCreatedEvent'
                        THEN concat('Shipment REF-', shipment_id, ' Created Successfully')
                    WHEN 'ShipmentStatusChangedEvent' THEN
                        concat('Your Shipment REF-', shipment_id,
                               CASE new_status WHEN 'IN_TRANSIT' THEN ' is In Transit'
                                    ELSE ' is Out for Delivery Today!' END)
                    WHEN 'ShipmentDeliveredEvent'
                        THEN concat('Shipment REF-', shipment_id, ' Delivered Successfully')
                    WHEN 'InvoiceApprovedEvent'
                        THEN concat('Invoice INV-', event_id, ' Approved for Payment')
                    WHEN 'InvoiceDisputedEvent'
                        THEN concat('ACTION REQUIRED: Invoice INV-', event_id,
                                    ' Disputed — OVERCHARGE')
                    ELSE concat('Carrier Rate Update: ', coalesce(carrier_name, 'null'),
                                ' — TX-CA-LTL') END AS subject,
               CASE WHEN body_event_type = 'CarrierRateUpdatedEvent' THEN coalesce(other_mail, '')
                    WHEN body_event_type IN ('ShipmentCreatedEvent', 'InvoiceApprovedEvent')
                        THEN coalesce(mail, '')
                    ELSE concat_ws(',', mail, other_mail) END AS recipients,
               carrier_name, shipment_id
        FROM queue
        WHERE readable AND (body_event_type IN ('ShipmentCreatedEvent', 'ShipmentDeliveredEvent',
                  'InvoiceApprovedEvent', 'InvoiceDisputedEvent', 'CarrierRateUpdatedEvent')
              OR body_event_type = 'ShipmentStatusChangedEvent'
                 AND new_status IN ('IN_TRANSIT', 'OUT_FOR_DELIVERY'))"""),
    "allowed": ("", """
        SELECT * FROM (VALUES
            ('CREATED', 'CARRIER_ASSIGNED'), ('CREATED', 'CANCELLED'),
            ('CARRIER_ASSIGNED', 'PICKED_UP'), ('CARRIER_ASSIGNED', 'CANCELLED'),
            ('PICKED_UP', 'IN_TRANSIT'),
            ('IN_TRANSIT', 'OUT_FOR_DELIVERY'), ('IN_TRANSIT', 'EXCEPTION'),
            ('OUT_FOR_DELIVERY', 'DELIVERED'), ('OUT_FOR_DELIVERY', 'EXCEPTION'),
            ('EXCEPTION', 'IN_TRANSIT'), ('EXCEPTION', 'OUT_FOR_DELIVERY'),
            ('EXCEPTION', 'CANCELLED')) t(old_status, new_status)"""),
    "requests": ("tracking", """
        SELECT *, row_number() OVER (PARTITION BY shipment_id ORDER BY ts, event_id) AS nth
        FROM tracking WHERE wanted IS NOT NULL"""),
    "fold": ("requests allowed", """
        SELECT * FROM (
            WITH RECURSIVE walk AS (
                SELECT shipment_id, cast(0 AS bigint) AS nth, 'CARRIER_ASSIGNED' AS before,
                       'CARRIER_ASSIGNED' AS after, false AS accepted
                FROM requests GROUP BY shipment_id
                UNION ALL
                SELECT r.shipment_id, r.nth, w.after,
                       CASE WHEN a.new_status IS NULL THEN w.after ELSE r.wanted END,
                       a.new_status IS NOT NULL
                FROM walk w
                JOIN requests r ON r.shipment_id = w.shipment_id AND r.nth = w.nth + 1
                LEFT JOIN allowed a ON a.old_status = w.after AND a.new_status = r.wanted)
            SELECT r.event_id, r.shipment_id, r.ts, r.wanted AS requested_status,
                   w.before AS old_status, w.after AS new_status, w.accepted, r.status_reason,
                   r.location
            FROM walk w JOIN requests r ON r.shipment_id = w.shipment_id AND r.nth = w.nth)"""),
    "delivered_requests": ("tracking", """
        SELECT *, ts < max(newest) OVER (ORDER BY delivery RANGE BETWEEN UNBOUNDED PRECEDING
                                         AND 1 PRECEDING) - interval 21 day IS TRUE AS late
        FROM (SELECT *, max(ts) OVER (PARTITION BY delivery) AS newest
              FROM (SELECT *, greatest(0, floor((cast(ts AS date) - date '2024-01-01') / 7)
                              + CASE WHEN event_id % 97 = 0 THEN 6 ELSE event_id % 3 END)
                              AS delivery
                    FROM tracking WHERE wanted IS NOT NULL))"""),
    "ordered_fold": ("delivered_requests allowed", """
        SELECT * FROM (
            WITH RECURSIVE timely AS (
                SELECT *, row_number() OVER (PARTITION BY shipment_id
                                             ORDER BY ts, cast(event_id AS varchar)) AS nth
                FROM delivered_requests WHERE NOT late),
            walk AS (
                SELECT shipment_id, cast(0 AS bigint) AS nth, 'CARRIER_ASSIGNED' AS before,
                       'CARRIER_ASSIGNED' AS after, false AS accepted
                FROM timely GROUP BY shipment_id
                UNION ALL
                SELECT r.shipment_id, r.nth, w.after,
                       CASE WHEN a.new_status IS NULL THEN w.after ELSE r.wanted END,
                       a.new_status IS NOT NULL
                FROM walk w
                JOIN timely r ON r.shipment_id = w.shipment_id AND r.nth = w.nth + 1
                LEFT JOIN allowed a ON a.old_status = w.after AND a.new_status = r.wanted)
            SELECT r.event_id, r.shipment_id, r.ts, r.wanted AS requested_status,
                   w.before AS old_status, w.after AS new_status, w.accepted, false AS late
            FROM walk w JOIN timely r ON r.shipment_id = w.shipment_id AND r.nth = w.nth
            UNION ALL
            SELECT event_id, shipment_id, ts, wanted, NULL, NULL, false, true
            FROM delivered_requests WHERE late)"""),
    "logs": ("", """
        SELECT event_id, ts,
               CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN 'ERROR'
                    WHEN event_type = 'error' THEN 'ERROR_FATAL' ELSE 'INFO' END AS level,
               concat('service-', event_id % 3) AS service, 'prod' AS environment,
               concat('line ', event_id) AS message,
               cast(floor(value * 10) AS bigint) AS duration_ms
        FROM events"""),
    "asked": ("shipments", """
        SELECT shipment_id, k % 17 = 0 AS bad_mail, k % 23 = 0 AS blank_city,
               k % 29 = 0 AS long_state, k % 31 = 0 AND weight_lbs IS NOT NULL AS bad_weight,
               k % 37 = 0 AS bad_value, k % 43 = 0 AS long_name, k % 41 = 0 AS bad_other_mail,
               k % 47 = 0 AS long_from_zip, k % 53 = 0 AS long_to_zip, k % 59 = 0 AS long_note
        FROM shipments"""),
}


def cents(amount: str) -> str:
    return f"cast({amount} * 100 AS hugeint)"


def half_up(top: str, bottom: str, scale: int, width: int = 18) -> str:
    """top / bottom rounded half away from zero, from exact integers."""
    ten = 10 ** scale
    whole = f"((2 * abs({top}) * {ten} + abs({bottom})) // (2 * abs({bottom})))"
    sign = f"(CASE WHEN ({top} < 0) <> ({bottom} < 0) THEN -1 ELSE 1 END)"
    unit = f"cast({1 / ten:.{scale}f} AS decimal({scale + 1},{scale}))"
    return f"(cast({sign} * {whole} AS decimal({width},0)) * {unit})"


def whole_days(start: str, end: str) -> str:
    return f"cast(trunc((epoch({end}) - epoch({start})) / {SECONDS_PER_DAY}) AS bigint)"


def percent_off(invoiced: str, expected: str) -> str:
    """Signed discrepancy in percent, two decimals, as decimal."""
    gap = cents(f"({invoiced} - {expected})")
    return (f"CASE WHEN {invoiced} IS NULL OR {expected} IS NULL OR {expected} = 0 THEN 0 ELSE "
            f"cast({half_up(gap, cents(expected), 4)} * 100 AS decimal(18,2)) END")


def contract(weight: str) -> str:
    charge = (f"(cast(round({weight} * 0.01, 4) AS decimal(12,4)) * rate_per_cwt * "
              f"(1 + fuel_surcharge_percent * 0.01))")
    return (f"CASE WHEN {weight} IS NULL OR rate_per_cwt IS NULL THEN coalesce(minimum_charge, 0) "
            f"WHEN {charge} < minimum_charge THEN minimum_charge "
            f"ELSE cast(round({charge}, 2) AS decimal(12,2)) END")


def cube(copies: str) -> str:
    return f"""
        SELECT carrier_id, carrier_name, origin_state, dest_state, gl_code, shipment_date,
               shipment_count, cast(weight AS double) AS total_weight_lbs,
               cast(rate AS double) AS total_negotiated_rate,
               cast(approved AS double) AS total_invoiced_amount,
               cast(weight AS double) / weighed AS avg_weight_lbs,
               on_time_count, auto_approved_count, disputed_count,
               on_time_count / shipment_count AS on_time_rate,
               auto_approved_count / shipment_count AS auto_approval_rate,
               CASE WHEN weight > 0 THEN cast(approved AS double) / cast(weight AS double) END
                   AS cost_per_lb,
               concat(origin_state, '-', dest_state) AS lane_id,
               strftime(shipment_date, '%Y-%m-%d') AS processing_date
        FROM (SELECT s.carrier_id, s.carrier_name, s.origin_state, s.dest_state, s.gl_code,
                     cast(s.created_at AS date) AS shipment_date,
                     cast(sum({copies}) AS bigint) AS shipment_count,
                     sum(s.weight_lbs * {copies}) AS weight,
                     cast(sum(CASE WHEN s.weight_lbs IS NOT NULL THEN {copies} END) AS bigint)
                         AS weighed,
                     sum(s.negotiated_rate * {copies}) AS rate, sum(i.approved_amount) AS approved,
                     cast(sum(CASE WHEN s.actual_delivery <= s.estimated_delivery THEN {copies}
                              ELSE 0 END) AS bigint) AS on_time_count,
                     count(*) FILTER (i.auto_approved) AS auto_approved_count,
                     count(*) FILTER (i.status = 'DISPUTED') AS disputed_count
              FROM shipments s LEFT JOIN
                   (SELECT *, row_number() OVER (PARTITION BY shipment_id ORDER BY invoice_id)
                        AS nth FROM invoices) i
                   ON i.shipment_id = s.shipment_id
              WHERE s.status = 'DELIVERED' {{where}}
              GROUP BY ALL)"""


def scores(first: str, last: str, lookback: int) -> str:
    otr = half_up("100 * on_time_deliveries", "total_shipments", 2)
    disputes = half_up("100 * disputed_invoices", "total_invoices", 2)
    dr = f"CASE WHEN total_invoices > 0 THEN {disputes} ELSE 0 END"
    variance = half_up("(cast(ad AS hugeint) * cn - cast(cd AS hugeint) * an)",
                       "(cast(an AS hugeint) * cn)", 1)
    return f"""
        , m AS (
            SELECT carrier_id, carrier_name, count(*) AS total_shipments,
                   count(*) FILTER (cast(actual_delivery AS date)
                                    <= cast(estimated_delivery AS date)) AS on_time_deliveries,
                   cast(sum({whole_days('created_at', 'actual_delivery')}) AS bigint) AS ad,
                   count(actual_delivery) AS an,
                   cast(sum({whole_days('created_at', 'estimated_delivery')}) AS bigint) AS cd,
                   count(estimated_delivery) AS cn, sum(weight_lbs) AS w, count(weight_lbs) AS wn,
                   sum(negotiated_rate) AS cost,
                   count(DISTINCT concat(origin_state, '|', dest_state)) AS distinct_lanes_served
            FROM shipments
            WHERE status IN ('DELIVERED', 'IN_TRANSIT', 'OUT_FOR_DELIVERY')
              AND cast(created_at AS date) BETWEEN date '{first}' AND date '{last}'
            GROUP BY carrier_id, carrier_name),
        i AS (
            SELECT carrier_id, count(shipment_id) AS total_invoices,
                   count(*) FILTER (status = 'DISPUTED') AS disputed_invoices,
                   sum(invoiced_amount) AS invoiced, sum(approved_amount) AS approved,
                   count(invoiced_amount) AS invoiced_n
            FROM invoices
            WHERE cast(created_at AS date) BETWEEN date '{first}' AND date '{last}'
            GROUP BY carrier_id),
        r AS (SELECT m.*, i.* EXCLUDE (carrier_id), cast({otr} AS decimal(9,2)) AS otr,
                     cast({dr} AS decimal(9,2)) AS dr
              FROM m LEFT JOIN i ON i.carrier_id = m.carrier_id),
        s AS (SELECT *, cast(round(otr * 0.6 + (100 - dr) * 0.4, 1) AS decimal(5,1)) AS score
              FROM r)
        SELECT carrier_id, carrier_name, total_shipments, on_time_deliveries,
               cast(w AS double) AS total_weight_lbs, cast(cost AS double) AS total_negotiated_cost,
               distinct_lanes_served, total_invoices, disputed_invoices,
               cast(invoiced AS double) AS total_invoiced_amount,
               cast(approved AS double) AS total_approved_amount,
               cast(ad AS double) / nullif(an, 0) AS avg_actual_transit_days,
               cast(cd AS double) / nullif(cn, 0) AS avg_committed_transit_days,
               cast(w AS double) / nullif(wn, 0) AS avg_shipment_weight_lbs,
               cast(invoiced AS double) / invoiced_n AS avg_invoice_amount,
               cast(otr AS double) AS on_time_rate_pct, cast(dr AS double) AS dispute_rate_pct,
               CASE WHEN w > 0 THEN cast({half_up(cents('approved'), cents('w'), 4)} AS double) END
                   AS cost_per_lb,
               CASE WHEN an > 0 THEN cast({variance} AS double) END AS transit_days_variance,
               cast(score AS double) AS overall_score,
               CASE WHEN score >= 90 THEN 'PREFERRED' WHEN score >= 75 THEN 'STANDARD'
                    WHEN score >= 60 THEN 'WATCH' ELSE 'REVIEW_REQUIRED' END AS carrier_tier,
               '{last}' AS processing_date, {lookback} AS lookback_days, '{first}' AS window_start
        FROM s"""


DTO = """shipment_id, reference_no, shipper_id, shipper_name, consignee_name, origin_city,
    origin_state, dest_city, dest_state, carrier_id, carrier_name, carrier_tracking_number, status,
    cast(weight_lbs AS double) AS weight_lbs, cast(declared_value AS double) AS declared_value,
    estimated_delivery, actual_delivery, gl_code, created_at, updated_at"""


def matched(source: str) -> str:
    """Decisions over rows with invoiced_amount, expected_amount and shipment_found."""
    return f"""
        SELECT *, invoiced_amount - expected_amount AS gap,
               {percent_off('invoiced_amount', 'expected_amount')} AS pct,
               CASE WHEN NOT shipment_found THEN 'MISSING_REFERENCE'
                    WHEN expected_amount IS NULL THEN 'RATE_NOT_FOUND'
                    WHEN abs(invoiced_amount - expected_amount) <= 5
                         OR abs({percent_off('invoiced_amount', 'expected_amount')}) <= 2 THEN NULL
                    WHEN invoiced_amount > expected_amount THEN 'OVERCHARGE'
                    ELSE 'UNDERCHARGE' END AS match_reason
        FROM ({source})"""


DECISION = """
    invoice_id,
    CASE WHEN match_reason IS NULL THEN 'APPROVED' ELSE 'DISPUTED' END AS match_outcome,
    match_reason, description AS match_description,
    CASE WHEN match_reason IS NULL THEN 'APPROVED'
         WHEN match_reason IN ('OVERCHARGE', 'UNDERCHARGE') THEN 'DISPUTED'
         ELSE 'MATCHING' END AS status,
    CASE WHEN match_reason IS NULL THEN true ELSE auto_approved END AS auto_approved,
    cast(CASE WHEN match_reason IS NULL THEN expected_amount ELSE approved_amount END AS double)
        AS approved_amount,
    CASE WHEN match_reason IN ('OVERCHARGE', 'UNDERCHARGE') THEN match_reason END
        AS dispute_reason,
    CASE WHEN match_reason IN ('OVERCHARGE', 'UNDERCHARGE') THEN description END
        AS dispute_description"""


def decided(source: str) -> str:
    return f"""
        SELECT *, CASE match_reason
            WHEN 'MISSING_REFERENCE' THEN
                concat('No matching shipment found for reference: ', shipment_reference_number)
            WHEN 'RATE_NOT_FOUND' THEN
                concat('Could not find contracted rate for carrier ', carrier_id)
            ELSE CASE WHEN match_reason IS NULL
                THEN concat('Within tolerance (diff=$', cast(abs(gap) AS decimal(12,2)), ')')
                ELSE concat('Invoice amount $', invoiced_amount, ' differs from expected $',
                            expected_amount, ' by $', cast(abs(gap) AS decimal(12,2)), ' (',
                            cast(round(abs(pct), 1) AS decimal(18,1)), '%)') END END AS description
        FROM ({matched(source)})"""


FIRST_IN_BATCH = """
    SELECT * FROM (
        SELECT *, row_number() OVER (PARTITION BY invoice_number
            ORDER BY received_at, invoiced_amount, carrier_id, gl_code, currency NULLS FIRST,
                     description, charge_type, quantity, unit_price, batch) AS nth
        FROM incoming
        WHERE batch <> 'A'
          AND invoice_number NOT IN (SELECT invoice_number FROM incoming WHERE batch = 'A'))
    WHERE nth = 1"""

NEWEST_RATE = """
    SELECT carrier_id, lane_id, refresh_id, cast(rate AS double) AS rate_per_cwt
    FROM (SELECT *, row_number() OVER (PARTITION BY carrier_id, lane_id
                                       ORDER BY refreshed_at DESC, refresh_id DESC) AS nth
          FROM history) WHERE nth = 1"""


def hourly(statistic: str) -> str:
    """Statistic per hour and service."""
    if statistic == "p99":
        return """
            SELECT period_start, service, cast(min(duration_ms) AS double) AS statistic
            FROM (SELECT *, row_number() OVER (PARTITION BY period_start, service
                                               ORDER BY duration_ms) AS nth,
                         count(*) OVER (PARTITION BY period_start, service) AS n
                  FROM (SELECT date_trunc('hour', ts) AS period_start, service, duration_ms
                        FROM logs))
            WHERE nth >= ceil(n * 99 / 100) GROUP BY period_start, service"""
    value = {"average": "cast(sum(duration_ms) AS double) / count(duration_ms)",
             "sum": "cast(sum(duration_ms) AS double)"}[statistic]
    return f"""SELECT date_trunc('hour', ts) AS period_start, service, {value} AS statistic
               FROM logs GROUP BY 1, 2"""


def hourly_alarm(statistic: str, threshold: float) -> str:
    return f"""
        SELECT a.period_start, a.service, a.statistic, a.statistic >= {threshold} AS breaching,
               a.statistic >= {threshold} AND coalesce(b.statistic >= {threshold}, false)
                   AS in_alarm
        FROM ({hourly(statistic)}) a
        LEFT JOIN ({hourly(statistic)}) b
               ON b.service = a.service AND b.period_start = a.period_start - interval 1 hour"""


CREATE_RULES = """concat_ws(',',
    CASE WHEN bad_mail THEN 'shipper_email_valid' END,
    CASE WHEN blank_city THEN 'origin_city_not_blank' END,
    CASE WHEN long_state THEN 'origin_state_length' END,
    CASE WHEN bad_weight THEN 'weight_positive' END,
    CASE WHEN bad_value THEN 'declared_value_not_negative' END,
    CASE WHEN long_name THEN 'consignee_name_length' END,
    CASE WHEN bad_other_mail THEN 'consignee_email_valid' END,
    CASE WHEN long_from_zip THEN 'origin_zip_length' END,
    CASE WHEN long_to_zip THEN 'dest_zip_length' END,
    CASE WHEN long_note THEN 'special_instructions_length' END)"""

FOLD_COLUMNS = """SELECT event_id, shipment_id, ts, requested_status, old_status, new_status,
    accepted FROM fold"""

PERIOD = "time_bucket(interval 60 seconds, {}, timestamp '1970-01-01')"

# query name -> (views, SQL)
SQL: dict[str, tuple[str, str]] = {
    "freight_spend_daily": ("shipments invoices", cube("1").format(where="")),
    "freight_spend_by_shipment_grain": (
        "shipments invoices",
        cube("(CASE WHEN coalesce(i.nth, 1) = 1 THEN 1 ELSE 0 END)").format(where="")),
    "freight_spend_one_day": ("shipments invoices", cube("1").format(
        where="AND cast(s.created_at AS date) = date '1998-03-15'")),
    "carrier_scorecard": ("shipments invoices", scores("1998-05-31", "1998-06-30", 30)),
    "carrier_scorecard_all_time": ("shipments invoices",
                                   scores("1993-10-14", "2001-12-31", 3000)),
    "report_spend_all": ("invoices", """
        SELECT carrier_id, carrier_name, cast(sum(approved_amount) AS double) AS total_spend,
               count(*) AS invoice_count
        FROM invoices WHERE invoice_date >= date '1998-07-01' - interval 365 day
        GROUP BY carrier_id, carrier_name"""),
    "report_spend_carrier": ("invoices", """
        SELECT carrier_id, carrier_name, gl_code,
               cast(sum(approved_amount) AS double) AS total_spend, count(*) AS invoice_count
        FROM invoices
        WHERE carrier_id = '7' AND invoice_date >= date '1998-07-01' - interval 365 day
        GROUP BY carrier_id, carrier_name, gl_code"""),
    "report_performance": ("shipments", f"""
        SELECT carrier_id, carrier_name,
               cast({half_up("100 * on_time", "n", 1)} AS double) AS on_time_rate_pct,
               n AS total_shipments,
               cast({half_up(cents("w"), "(100 * cast(wn AS hugeint))", 0)} AS double)
                   AS avg_weight_lbs
        FROM (SELECT carrier_id, carrier_name, count(*) AS n,
                     count(*) FILTER (actual_delivery <= estimated_delivery) AS on_time,
                     sum(weight_lbs) AS w, count(weight_lbs) AS wn
              FROM shipments WHERE actual_delivery >= timestamp '1998-07-01' - interval 180 day
              GROUP BY carrier_id, carrier_name)"""),
    "report_spend_as_text": ("invoices", """
        SELECT carrier_id, carrier_name, cast(sum(approved_amount) AS varchar) AS total_spend,
               cast(count(*) AS varchar) AS invoice_count
        FROM invoices WHERE invoice_date >= date '1998-07-01' - interval 30 day
        GROUP BY carrier_id, carrier_name"""),
    "adhoc_sql": ("invoices", """
        SELECT gl_code, count(*) AS invoices, cast(sum(approved_amount) AS double) AS approved
        FROM invoices WHERE approved_amount >= 1000 GROUP BY gl_code"""),
    "shipment_search": ("shipments", f"""
        SELECT {DTO} FROM shipments
        WHERE status = 'DELIVERED' AND created_at >= timestamp '1996-01-01'
          AND created_at <= timestamp '1999-12-31 12:00:00'
          AND lower(origin_city) LIKE '%nation_1%' AND lower(dest_city) LIKE '%town%'"""),
    "shipment_search_page": ("shipments", f"""
        SELECT {DTO} FROM shipments ORDER BY created_at DESC, shipment_id LIMIT 50 OFFSET 100"""),
    "shipment_page_after": ("shipments", f"""
        SELECT {DTO} FROM shipments
        WHERE created_at < timestamp '1998-05-05 05:00:00'
           OR created_at = timestamp '1998-05-05 05:00:00' AND shipment_id > '5'
        ORDER BY created_at DESC, shipment_id LIMIT 100"""),
    "page_totals": ("", """
        SELECT 3 AS page, 20 AS size, count(*) AS total_elements,
               cast(ceil(count(*) / 20.0) AS bigint) AS total_pages, false AS first,
               4 >= ceil(count(*) / 20.0) AS last
        FROM orders"""),
    "shipper_history": ("shipments", f"SELECT {DTO} FROM shipments WHERE shipper_id = '77'"),
    "invoice_listing": ("invoices", """
        SELECT invoice_id, carrier_id, status, cast(invoiced_amount AS double) AS invoiced_amount
        FROM invoices WHERE status = 'DISPUTED'"""),
    "carrier_invoices": ("invoices", """
        SELECT invoice_id, shipment_id, status, cast(invoiced_amount AS double) AS invoiced_amount
        FROM invoices WHERE carrier_id = '7'"""),
    "overdue_shipments": ("shipments", """
        SELECT shipment_id, status, estimated_delivery FROM shipments
        WHERE status IN ('IN_TRANSIT', 'OUT_FOR_DELIVERY')
          AND estimated_delivery < timestamp '1999-01-01'"""),
    "overdue_invoices": ("invoices", """
        SELECT invoice_id, payment_due_date, cast(approved_amount AS double) AS approved_amount
        FROM invoices
        WHERE status = 'APPROVED' AND payment_due_date <= date '1999-01-01'
          AND paid_at IS NULL"""),
    "status_counts_since": ("shipments", """
        SELECT status, count(*) AS shipments FROM shipments
        WHERE created_at >= timestamp '1997-01-01' GROUP BY status"""),
    "invoice_with_lines": ("invoices incoming", """
        SELECT i.invoice_id, i.invoice_number, i.status, 0 AS part, coalesce(l.items, '')
                   AS line_items
        FROM invoices i LEFT JOIN (
            SELECT invoice_id,
                   string_agg(concat_ws(':', description, charge_type, invoiced_amount), ';'
                       ORDER BY description, charge_type, quantity, unit_price, invoiced_amount,
                                gl_code) AS items
            FROM incoming GROUP BY invoice_id) l ON l.invoice_id = i.invoice_id"""),
    "shipment_with_legs": ("shipments legs", """
        SELECT s.shipment_id, s.status, 0 AS part, coalesce(l.n, 0) AS leg_count,
               coalesce(l.items, '') AS legs
        FROM shipments s LEFT JOIN (
            SELECT shipment_id, count(*) AS n,
                   string_agg(concat(sequence, ':', suppkey), ';' ORDER BY sequence) AS items
            FROM legs GROUP BY shipment_id) l ON l.shipment_id = s.shipment_id"""),
    "multi_carrier_quote": ("shipments rates", f"""
        SELECT q.lane_id, cast(weight_lbs AS double) AS weight_lbs, carrier_id, carrier_name,
               cast({contract('weight_lbs')} AS double) AS total_rate, transit_days
        FROM (SELECT DISTINCT concat(origin_state, '-', dest_state, '-', shipment_type) AS lane_id,
                     weight_lbs FROM shipments) q
        JOIN rates r ON r.lane_id = q.lane_id WHERE r.active"""),
    "best_quote": ("shipments rates", f"""
        SELECT lane_id, cast(weight_lbs AS double) AS weight_lbs,
               cast(total AS double) AS total_rate, carrier_id, carrier_name, transit_days
        FROM (SELECT *, row_number() OVER (PARTITION BY lane_id, weight_lbs
                                           ORDER BY total, carrier_id) AS nth
              FROM (SELECT q.lane_id, weight_lbs, carrier_id, carrier_name, transit_days,
                           {contract('weight_lbs')} AS total
                    FROM (SELECT DISTINCT concat(origin_state, '-', dest_state, '-', shipment_type)
                                     AS lane_id, weight_lbs FROM shipments) q
                    JOIN rates r ON r.lane_id = q.lane_id WHERE r.active))
        WHERE nth = 1"""),
    "ranked_quotes": ("shipments rates", f"""
        SELECT lane_id, cast(weight_lbs AS double) AS weight_lbs, carrier_id,
               cast(total AS double) AS total_rate,
               row_number() OVER (PARTITION BY lane_id, weight_lbs ORDER BY total, carrier_id)
                   AS rank
        FROM (SELECT q.lane_id, weight_lbs, carrier_id, {contract('weight_lbs')} AS total
              FROM (SELECT DISTINCT concat(origin_state, '-', dest_state, '-', shipment_type)
                               AS lane_id, weight_lbs FROM shipments) q
              JOIN rates r ON r.lane_id = q.lane_id WHERE r.active)"""),
    "rate_lookup": ("rates", """
        SELECT carrier_id, carrier_name, lane_id, origin_state, dest_state, shipment_type,
               cast(rate_per_cwt AS double) AS rate_per_cwt,
               cast(fuel_surcharge_percent AS double) AS fuel_surcharge_percent,
               cast(minimum_charge AS double) AS minimum_charge, transit_days, active
        FROM rates WHERE carrier_id = '7' AND shipment_type = 'LTL' AND active"""),
    "weight_buckets": ("shipments", """
        SELECT coalesce(cast(floor(weight_lbs / 50) AS int) * 50, 0) AS bucket,
               count(*) AS shipments
        FROM shipments GROUP BY 1"""),
    "rate_changes": ("history", f"""
        SELECT carrier_id, lane_id, refreshed_at, refresh_id,
               cast(before AS double) AS previous_rate, cast(rate AS double) AS new_rate,
               CASE WHEN before IS NOT NULL THEN cast({percent_off('rate', 'before')} AS double)
                   END AS change_percent,
               CASE WHEN before IS NOT NULL THEN {percent_off('rate', 'before')} > 0 END
                   AS rate_increased
        FROM (SELECT *, lag(rate) OVER (PARTITION BY carrier_id, lane_id
                                        ORDER BY refreshed_at, refresh_id) AS before
              FROM history)"""),
    "latest_rate_per_key": ("history", NEWEST_RATE),
    "rate_upsert": ("history", NEWEST_RATE),
    "rate_valid_on_date": ("shipments", """
        SELECT shipment_id, date '1995-01-01' + cast(800 * v AS int) AS effective_date,
               cast(5 + (s_suppkey * 7 + n_nationkey) % 11 + v AS double) AS rate_per_cwt
        FROM (SELECT s.shipment_id, s.s_suppkey, n.n_nationkey,
                     least(2, (cast(s.created_at AS date) - date '1995-01-01') // 800) AS v
              FROM shipments s JOIN nation n ON n.n_name = s.dest_state)"""),
    "rate_fallback": ("rates", """
        SELECT carrier_id, lane_id, origin_state, dest_state, shipment_type,
               cast(rate_per_cwt AS double) AS rate_per_cwt,
               cast(fuel_surcharge_percent AS double) AS fuel_surcharge_percent,
               coalesce(cast(minimum_charge AS double), 0) AS minimum_charge, transit_days,
               'fresh' AS card_source, true AS active, date '1998-01-01' AS effective_date
        FROM rates WHERE active AND NOT (carrier_id = '7' AND shipment_type = 'FTL')
        UNION ALL
        SELECT c.carrier_id, v.lane_id, split_part(v.lane_id, '-', 1),
               split_part(v.lane_id, '-', 2), split_part(v.lane_id, '-', 3), v.rate, v.fuel, v.least,
               v.days, 'literal', true, date '1998-01-01'
        FROM (SELECT CASE s_suppkey WHEN 0 THEN 'FedEx' ELSE 'dhl' END AS carrier_id
              FROM supplier WHERE s_suppkey IN (0, 10)) c
        JOIN (VALUES ('FedEx', 'TX-CA-LTL', 12.5::double, 18.5::double, 250::double, 3),
                     ('FedEx', 'NY-FL-LTL', 14.2, 18.5, 300, 2),
                     ('FedEx', 'IL-TX-FTL', 2.8, 22, 1200, 2),
                     ('FedEx', 'CA-WA-LTL', 10.5, 17, 200, 2),
                     ('dhl', 'TX-CA-LTL', 13.1, 19, 260, 3),
                     ('dhl', 'NY-FL-LTL', 14.8, 19, 310, 2)) v(carrier, lane_id, rate, fuel, least, days)
          ON v.carrier = c.carrier_id"""),
    "rate_refresh_counts": ("rates", """
        SELECT cast((SELECT count(*) FROM rates
                     WHERE active AND NOT (carrier_id = '7' AND shipment_type = 'FTL'))
                    + sum(CASE s_suppkey WHEN 0 THEN 4 WHEN 10 THEN 2 ELSE 0 END) AS bigint)
                   AS updated,
               count(*) FILTER (s_suppkey <> 7) AS carriers_processed,
               count(*) FILTER (s_suppkey = 7) AS carriers_failed
        FROM supplier"""),
    "rate_event_messages": ("rates", """
        SELECT 'CarrierRateUpdatedEvent' AS event_type, carrier_id, lane_id,
               'CarrierRateUpdatedEvent' AS "eventType", origin_state AS "originState",
               dest_state AS "destinationState", cast(rate_per_cwt AS varchar) AS "ratePerCwt",
               '1998-01-01T06:00:00Z' AS "effectiveDate"
        FROM rates"""),
    "three_way_match": ("invoices", f"""
        SELECT {DECISION}
        FROM ({decided("SELECT *, true AS shipment_found FROM invoices")})"""),
    "contract_match": ("shipments invoices rates", f"""
        SELECT cast(expected_amount AS double) AS expected_amount, {DECISION}
        FROM ({decided(f'''
            SELECT i.* EXCLUDE (expected_amount), s.shipment_id IS NOT NULL AS shipment_found,
                   CASE WHEN r.carrier_id IS NOT NULL
                        THEN cast({contract('s.weight_lbs')} AS decimal(12,2)) END
                       AS expected_amount
            FROM invoices i
            LEFT JOIN (SELECT * FROM shipments WHERE status <> 'CANCELLED') s
                   ON s.shipment_id = i.shipment_id
            LEFT JOIN (SELECT * FROM rates WHERE active) r
                   ON r.carrier_id = s.carrier_id
                  AND r.lane_id = concat(s.origin_state, '-', s.dest_state, '-', s.shipment_type)
            ''')})"""),
    "match_on_delivery": ("shipments invoices", f"""
        SELECT CASE WHEN match_reason IS NULL THEN 'APPROVED' ELSE 'DISPUTED' END
                   AS match_outcome, match_reason, count(*) AS invoices
        FROM ({matched('''SELECT i.*, true AS shipment_found FROM invoices i
                          JOIN shipments s ON s.shipment_id = i.shipment_id
                          WHERE s.status = 'DELIVERED' ''')})
        GROUP BY ALL"""),
    "invoice_events": ("invoices", f"""
        SELECT CASE WHEN ok THEN 'InvoiceApprovedEvent' ELSE 'InvoiceDisputedEvent' END
                   AS event_type, invoice_id, invoice_number, carrier_id, shipment_id,
               CASE WHEN ok THEN cast(expected_amount AS double) END AS approved_amount,
               CASE WHEN ok THEN 'USD' END AS currency, CASE WHEN ok THEN gl_code END AS gl_code,
               CASE WHEN ok THEN invoice_date END AS invoice_date,
               CASE WHEN ok THEN payment_due_date END AS payment_due_date,
               CASE WHEN ok THEN true END AS auto_approved,
               CASE WHEN ok THEN payment_due_date + interval 1 hour END AS approved_at,
               CASE WHEN NOT ok THEN cast(invoiced_amount AS double) END AS invoiced_amount,
               CASE WHEN NOT ok THEN cast(expected_amount AS double) END AS expected_amount,
               CASE WHEN NOT ok THEN cast(gap AS double) END AS discrepancy_amount,
               CASE WHEN NOT ok THEN cast(pct AS double) END AS discrepancy_percentage,
               CASE WHEN match_reason IN ('OVERCHARGE', 'UNDERCHARGE') THEN match_reason END
                   AS dispute_reason
        FROM (SELECT *, match_reason IS NULL AS ok
              FROM ({matched('SELECT *, true AS shipment_found FROM invoices')}))"""),
    "discrepancy_flags": ("invoices", f"""
        SELECT invoice_id, coalesce(abs(invoiced_amount - expected_amount) > 100, false)
                   AS has_discrepancy,
               cast(invoiced_amount - expected_amount AS double) AS discrepancy,
               cast({percent_off('invoiced_amount', 'expected_amount')} AS double) AS percent
        FROM invoices"""),
    "invoice_intake": ("incoming", f"""
        SELECT invoice_number, carrier_id, cast(invoiced_amount AS double) AS invoiced_amount,
               coalesce(currency, 'USD') AS currency, 'RECEIVED' AS status, invoice_date,
               invoice_date + 30 AS payment_due_date
        FROM ({FIRST_IN_BATCH})"""),
    "intake_line_items": ("incoming", f"""
        SELECT invoice_number, description, charge_type, cast(quantity AS double) AS quantity,
               cast(unit_price AS double) AS unit_price,
               cast(invoiced_amount AS double) AS total_amount, gl_code
        FROM ({FIRST_IN_BATCH})"""),
    "duplicate_invoices": ("incoming", """
        SELECT invoice_number, CASE WHEN known THEN n ELSE n - 1 END AS rejected,
               CASE WHEN known THEN 'ALREADY_EXISTS' ELSE 'REPEATED_IN_BATCH' END AS reason
        FROM (SELECT invoice_number, count(*) FILTER (batch <> 'A') AS n,
                     bool_or(batch = 'A') AS known
              FROM incoming GROUP BY invoice_number)
        WHERE n > 1 OR n = 1 AND known"""),
    "line_rollup": ("incoming", """
        SELECT charge_type, gl_code, count(*) AS line_count,
               cast(sum(quantity) AS double) AS total_quantity,
               cast(sum(invoiced_amount) AS double) AS total_amount
        FROM incoming GROUP BY charge_type, gl_code"""),
    "manual_approval": ("invoices", """
        SELECT invoice_id, CASE WHEN status = 'DISPUTED' THEN 'APPROVED' ELSE status END AS status,
               cast(CASE WHEN status = 'DISPUTED' THEN invoiced_amount ELSE approved_amount END
                    AS double) AS approved_amount,
               CASE WHEN status = 'DISPUTED' THEN 'ap-team' END AS approved_by,
               CASE WHEN status = 'DISPUTED' THEN created_at END AS approved_at
        FROM invoices"""),
    "approval_events": ("invoices", """
        SELECT 'InvoiceApprovedEvent' AS event_type, invoice_id, carrier_id, shipment_id,
               cast(invoiced_amount AS double) AS approved_amount, gl_code, auto_approved,
               created_at AS approved_at
        FROM invoices WHERE status = 'DISPUTED'"""),
    "undecided_invoices": ("invoices", """
        SELECT invoice_id, 'DISPUTED' AS match_outcome,
               CASE WHEN expected_amount IS NULL THEN 'RATE_NOT_FOUND' ELSE 'MISSING_AMOUNT' END
                   AS match_reason, 'MATCHING' AS status, auto_approved, approved_amount::double AS approved_amount,
               cast(NULL AS timestamp) AS approved_at
        FROM invoices"""),
    "paid_invoices": ("invoices", """
        SELECT invoice_id, CASE WHEN auto_approved THEN 'PAID' ELSE status END AS status,
               CASE WHEN auto_approved THEN created_at + interval 20 day ELSE paid_at END
                   AS paid_at
        FROM invoices"""),
    "webhook_intake": ("normalised", """
        SELECT *, CASE outcome WHEN 'OK' THEN 200 WHEN 'INVALID_SIGNATURE' THEN 401
                       WHEN 'ERROR' THEN 500 ELSE 400 END AS http_status
        FROM normalised"""),
    "webhook_outcomes": ("webhooks", """
        SELECT outcome, CASE outcome WHEN 'OK' THEN 200 WHEN 'INVALID_SIGNATURE' THEN 401
                             WHEN 'ERROR' THEN 500 ELSE 400 END AS http_status, count(*) AS calls
        FROM webhooks GROUP BY outcome"""),
    "tracking_messages": ("normalised", """
        SELECT 'TrackingEventReceivedEvent' AS event_type, carrier_id,
               concat('req-', event_id) AS correlation_id, shipment_id AS "body_shipmentId",
               carrier_tracking_number AS "body_carrierTrackingNumber",
               carrier_status AS "body_carrierStatus",
               status_description AS "body_statusDescription", location AS body_location,
               carrier_id AS "body_carrierId", concat('req-', event_id) AS "body_correlationId",
               strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS body_timestamp, '' AS body_event_type
        FROM normalised JOIN (SELECT event_id, ts FROM tracking) USING (event_id)
        WHERE outcome = 'OK'"""),
    "message_types": ("queue", "SELECT event_id, body_event_type, readable FROM queue"),
    "quarantine": ("queue", "SELECT readable, count(*) AS messages FROM queue GROUP BY readable"),
    "event_routing": ("queue", """
        SELECT event_id, topic, unnest(CASE
                   WHEN topic = 'invoice-events'
                       THEN ['notification-queue', 'invoice-processing-queue']
                   WHEN body_event_type = 'TrackingEventReceivedEvent'
                       THEN ['notification-queue', 'analytics-queue', 'shipment-inbound-queue']
                   ELSE ['notification-queue', 'analytics-queue'] END) AS queue
        FROM (SELECT event_id, body_event_type,
                     CASE WHEN body_event_type LIKE 'Invoice%' THEN 'invoice-events'
                          ELSE 'shipment-events' END AS topic
              FROM queue WHERE readable)"""),
    "event_dedup": ("tracking", """
        SELECT event_id, shipment_id, carrier_status, ts FROM tracking"""),
    "status_mapping": ("tracking", """
        SELECT carrier_status, wanted AS status, count(*) AS events
        FROM tracking GROUP BY carrier_status, wanted"""),
    "known_and_unknown_shipments": ("requests shipments", """
        SELECT r.event_id, r.shipment_id, s.shipment_id IS NOT NULL AS known
        FROM requests r
        LEFT JOIN (SELECT shipment_id FROM shipments WHERE status <> 'CANCELLED') s
               ON s.shipment_id = r.shipment_id"""),
    "lifecycle_fold": ("fold", FOLD_COLUMNS),
    "lifecycle_fold_sliced": ("fold", FOLD_COLUMNS),
    "lifecycle_final_status": ("fold", """
        SELECT shipment_id, arg_max(new_status, (ts, event_id)) AS status,
               count(*) FILTER (accepted) AS accepted, count(*) AS requests
        FROM fold GROUP BY shipment_id"""),
    "delivery_events": ("fold shipments", f"""
        SELECT 'ShipmentDeliveredEvent' AS event_type, f.shipment_id, s.reference_no,
               s.carrier_id, s.carrier_name, f.ts AS delivered_at,
               f.ts <= s.estimated_delivery AS on_time,
               cast({whole_days('f.ts', 's.estimated_delivery')} AS int) AS days_variance,
               s.shipper_email, s.consignee_email,
               cast(s.declared_value AS double) AS declared_value
        FROM fold f JOIN shipments s ON s.shipment_id = f.shipment_id
        WHERE f.accepted AND f.new_status = 'DELIVERED'"""),
    "status_changed_events": ("fold shipments", """
        SELECT 'ShipmentStatusChangedEvent' AS event_type, f.shipment_id, s.reference_no,
               f.old_status, f.new_status, f.status_reason, f.location, s.shipper_email,
               s.consignee_email, s.reference_no AS reference_display_name, f.ts AS occurred_at
        FROM fold f JOIN shipments s ON s.shipment_id = f.shipment_id
        WHERE f.accepted AND f.new_status <> 'DELIVERED'"""),
    "carrier_assignment": ("shipments", """
        SELECT 'CarrierAssignedEvent' AS event_type, shipment_id, reference_no, carrier_id,
               carrier_name, concat(carrier_id, ':', shipment_type) AS rate_id
        FROM shipments WHERE status = 'CREATED'"""),
    "created_events": ("shipments", """
        SELECT 'ShipmentCreatedEvent' AS event_type, shipment_id,
               'ShipmentCreatedEvent' AS "eventType", reference_no AS "referenceNumber",
               shipper_name AS "shipperName", origin_city AS "originCity",
               carrier_id AS "carrierId", consignee_email AS "consigneeEmail",
               strftime(estimated_delivery, '%Y-%m-%dT%H:%M:%S.%f') AS "estimatedDelivery",
               cast(weight_lbs AS double) AS "weightLbs"
        FROM shipments"""),
    "delivery_variance": ("shipments", f"""
        SELECT shipment_id, coalesce(actual_delivery <= estimated_delivery, false) AS on_time,
               coalesce(cast(actual_delivery AS date) <= cast(estimated_delivery AS date), false)
                   AS on_time_by_date,
               coalesce(cast({whole_days('actual_delivery', 'estimated_delivery')} AS int), 0)
                   AS days_variance,
               {whole_days('created_at', 'actual_delivery')} AS transit_days
        FROM shipments"""),
    "reference_numbers": ("shipments", """
        SELECT shipment_id, concat('SH-', strftime(created_at, '%Y%m%d'), '-',
                   lpad(cast(row_number() OVER (PARTITION BY cast(created_at AS date)
                       ORDER BY hour(created_at), substr(md5(shipment_id), 1, 4), shipment_id)
                       AS varchar), 6, '0')) AS reference_number
        FROM shipments"""),
    "lifecycle_in_event_time": ("ordered_fold", "SELECT * FROM ordered_fold"),
    "requests_before_shipments": ("requests shipments", """
        SELECT r.event_id, r.shipment_id, s.k % 4 <> 0 AND s.k IS NOT NULL
                   OR abs(epoch(s.arrives) - epoch(r.ts)) <= 864000 IS TRUE AS known,
               CASE WHEN s.k % 4 = 0 AND abs(epoch(s.arrives) - epoch(r.ts)) <= 864000
                    THEN s.arrives END AS arrived_at
        FROM requests r
        LEFT JOIN (SELECT shipment_id, k, CASE WHEN k % 4 = 0 THEN
                          timestamp '2024-01-01' + interval 1 hour * (k * 7 % 720) END AS arrives
                   FROM shipments) s
               ON s.shipment_id = r.shipment_id"""),
    "message_attempts": ("queue", """
        SELECT cast(event_id AS varchar) AS message_id, readable AND n > busy AS handled,
               cast(n AS int) AS attempt,
               CASE WHEN readable AND n > busy THEN 'done' WHEN n = 3 THEN 'dead_letter'
                    ELSE 'retry' END AS place
        FROM (SELECT event_id, readable,
                     CASE WHEN event_id % 77 = 0 THEN 2 WHEN event_id % 7 = 0 THEN 1 ELSE 0 END
                         AS busy
              FROM queue) q
        JOIN (VALUES (1), (2), (3)) t(n) ON n <= CASE WHEN readable THEN busy + 1 ELSE 3 END"""),
    "stream_lifecycle": ("fold", FOLD_COLUMNS),
    "stream_error_counts": ("logs", f"""
        SELECT {PERIOD.format('ts')} AS period_start, 'ErrorCount' AS metric,
               concat('service=', service) AS tags, count(*) AS value
        FROM logs WHERE level LIKE 'ERROR%' GROUP BY 1, 2, 3"""),
    "document_key_parse": ("parsed", """
        SELECT doc_id, s3_bucket, s3_key, file_size_bytes, outcome, file_name, document_type,
               shipment_id, document_id, extension, content_type
        FROM parsed"""),
    "document_batch_counts": ("", """
        SELECT count(*) AS processed, cast(0 AS bigint) AS failed FROM documents"""),
    "document_index": ("indexed", "SELECT * FROM indexed"),
    "documents_of_shipment": ("indexed", """
        SELECT document_id, s3_key, content_type, status FROM indexed
        WHERE shipment_id = 'ship 7'"""),
    "document_register": ("metadata", """
        SELECT document_id, shipment_id, document_type, uploaded_by, status, description,
               NULL AS s3_key, NULL AS content_type, cast(NULL AS timestamp) AS uploaded_at
        FROM metadata WHERE cast(substr(document_id, 5) AS bigint) % 3 <> 0
        UNION ALL
        SELECT concat('doc ', doc_id), 's-new', 'POD', 'clerk', 'UPLOADED', 'again',
               concat('pod/s-new/', doc_id, '.png'), 'application/octet-stream',
               timestamp '2024-03-11 00:00:00'
        FROM documents WHERE doc_id % 3 = 0"""),
    "document_delete": ("metadata", """
        SELECT document_id, uploaded_by, description FROM metadata
        WHERE cast(substr(document_id, 5) AS bigint) NOT IN
              (SELECT doc_id FROM labels WHERE toxic = 1)"""),
    "ocr_jobs": ("ocr", """
        SELECT 'OcrJobStartedEvent' AS event_type, concat('job-', doc_id) AS job_id, document_id,
               shipment_id, s3_key, s3_bucket, '2024-03-10T00:00:00.000000' AS started_at
        FROM ocr WHERE ocr_outcome = 'STARTED'"""),
    "ocr_batch_counts": ("ocr", """
        SELECT ocr_outcome, count(*) AS objects FROM ocr GROUP BY ocr_outcome"""),
    "ocr_job_documents": ("ocr indexed shipments", """
        SELECT replace(o.shipment_id, 'ship ', '') AS shipment_id, o.document_id,
               concat('job-', o.doc_id) AS job_id, d.file_name, d.content_type, d.uploaded_by,
               s.reference_no, s.carrier_id
        FROM ocr o LEFT JOIN indexed d ON d.document_id = o.document_id
        LEFT JOIN shipments s ON s.shipment_id = replace(o.shipment_id, 'ship ', '')
        WHERE o.ocr_outcome = 'STARTED'"""),
    "notification_outbox": ("mails", """
        SELECT event_id, template, subject, recipients, recipients <> '' AS is_deliverable,
               CASE kind WHEN 'ShipmentStatusChangedEvent' THEN 6
                    WHEN 'InvoiceApprovedEvent' THEN 10 WHEN 'InvoiceDisputedEvent' THEN 11
                    ELSE 9 END AS variable_count,
               CASE WHEN kind LIKE 'Shipment%' THEN
                        concat('https://freight.example.com/shipments/', shipment_id, '/tracking')
                    WHEN kind LIKE 'Invoice%' THEN
                        concat('https://freight.example.com/invoices/I', event_id) END AS link,
               CASE WHEN kind = 'ShipmentStatusChangedEvent' THEN NULL
                    WHEN kind = 'ShipmentCreatedEvent' THEN coalesce(carrier_name, 'TBD')
                    ELSE carrier_name END AS carrier_name,
               CASE WHEN kind = 'CarrierRateUpdatedEvent'
                    THEN cast(event_id % 21 - 10 > 0 AS varchar) END AS rate_increased
        FROM mails"""),
    "display_values": ("invoices", f"""
        SELECT invoice_id, concat('$', format('{{:,}}', cast(trunc(invoiced_amount) AS bigint)), '.',
                   lpad(cast(cast(invoiced_amount * 100 AS bigint) % 100 AS varchar), 2, '0'))
                   AS amount,
               concat(strftime(payment_due_date, '%b '), day(payment_due_date), ', ',
                      year(payment_due_date)) AS due,
               concat(cast(round(abs({percent_off('invoiced_amount', 'expected_amount')}), 1)
                           AS decimal(18,1)), '%') AS percent,
               concat('https://freight.example.com/invoices/', invoice_id) AS link
        FROM invoices"""),
    "places_and_lanes": ("shipments", """
        SELECT concat(origin_city, ', ', origin_state) AS origin,
               concat(origin_state, '-', dest_state) AS spend_lane,
               concat(origin_state, '-', dest_state, '-', shipment_type) AS rate_lane,
               count(*) AS shipments
        FROM shipments GROUP BY ALL"""),
    "metric_counts_per_window": ("shipments fold", f"""
        SELECT {PERIOD.format('created_at')} AS period_start, 'shipment.created.count' AS metric,
               'environment=test,service=shipment-service' AS tags, count(*) AS value
        FROM shipments GROUP BY ALL
        UNION ALL
        SELECT {PERIOD.format('actual_delivery')}, 'shipment.delivered.count',
               concat('environment=test,on_time=', actual_delivery <= estimated_delivery,
                      ',service=shipment-service'), count(*)
        FROM shipments WHERE actual_delivery IS NOT NULL GROUP BY ALL
        UNION ALL
        SELECT {PERIOD.format('ts')}, 'shipment.status.change.count',
               concat('environment=test,new=', new_status, ',old=', old_status,
                      ',service=shipment-service'), count(*)
        FROM fold WHERE accepted GROUP BY ALL"""),
    "duration_timers": ("logs", f"""
        SELECT {PERIOD.format('ts')} AS period_start, service, environment,
               count(duration_ms) AS count, cast(sum(duration_ms) AS bigint) AS sum,
               max(duration_ms) AS max
        FROM logs GROUP BY 1, 2, 3"""),
    "error_counts": ("logs", f"""
        SELECT {PERIOD.format('ts')} AS period_start, 'ErrorCount' AS metric,
               concat('service=', service) AS tags, count(*) AS value
        FROM logs WHERE level LIKE 'ERROR%' GROUP BY ALL"""),
    "latest_error_lines": ("logs", """
        SELECT event_id, ts, level, service, message FROM logs WHERE level LIKE 'ERROR%'
        ORDER BY ts DESC, event_id DESC LIMIT 50"""),
    "alarm_average": ("logs", hourly_alarm("average", catalogue.AVERAGE_MS)),
    "alarm_p99": ("logs", hourly_alarm("p99", catalogue.P99_MS)),
    "alarm_sum": ("logs", hourly_alarm("sum", catalogue.SUM_MS)),
    "alarm_two_minutes": ("logs", f"""
        SELECT period_start, service, statistic, statistic >= 200 AS breaching,
               statistic >= 200 AND coalesce(lag(statistic) OVER
                   (PARTITION BY service ORDER BY period_start) >= 200, false) AS in_alarm
        FROM (SELECT {PERIOD.format('ts')} AS period_start, service,
                     cast(sum(duration_ms) AS double) AS statistic
              FROM logs GROUP BY 1, 2)"""),
    "alarm_composite": ("logs", f"""
        SELECT period_start, bool_or(in_alarm) AS in_alarm
        FROM (SELECT period_start, in_alarm FROM ({hourly_alarm("average", catalogue.AVERAGE_MS)})
              UNION ALL
              SELECT period_start, in_alarm FROM ({hourly_alarm("p99", catalogue.P99_MS)}))
        GROUP BY period_start"""),
    "email_counts": ("mails", """
        SELECT date_trunc('day', ts)::timestamp AS period_start,
               CASE WHEN event_id % 13 = 0 THEN 'email.failure.count' ELSE 'email.sent.count' END
                   AS metric, 'environment=test,service=notification-service' AS tags,
               count(*) AS value
        FROM mails WHERE recipients <> '' GROUP BY ALL"""),
    "quality_violations": ("asked", f"""
        SELECT shipment_id, {CREATE_RULES} AS violations FROM asked
        WHERE bad_mail OR blank_city OR long_state OR bad_weight OR bad_value OR long_name
           OR bad_other_mail OR long_from_zip OR long_to_zip OR long_note"""),
    "quality_counts": ("legs shipments", """
        SELECT 'status_known' AS rule, count(*) AS rows, 'legs' AS "table"
        FROM legs WHERE suppkey % 5 = 0
        UNION ALL
        SELECT 'status_allowed', count(*), 'status_requests' FROM shipments
        WHERE status = 'CREATED'"""),
    "duplicate_keys": ("incoming", """
        SELECT invoice_number, count(*) AS rows FROM incoming
        GROUP BY invoice_number HAVING count(*) > 1"""),
    "orphan_children": ("legs shipments", """
        SELECT shipment_id, sequence FROM legs WHERE shipment_id NOT IN
               (SELECT shipment_id FROM shipments WHERE status <> 'CANCELLED')"""),
    "retention_filter": ("", """
        SELECT event_id, ts FROM events
        WHERE ts >= timestamp '2024-04-10' - interval 90 day"""),
    "partial_upsert": ("indexed", """
        SELECT document_id, shipment_id, status, uploaded_by, description, indexed_at
        FROM indexed"""),
}


def live_alarm(name: str, statistic: str, threshold: float) -> str:
    """The batch alarm, and the first hour without data after each hour with data."""
    return f"""
        SELECT period_start, service, '{name}' AS alarm, statistic, breaching, in_alarm
        FROM ({hourly_alarm(statistic, threshold)})
        UNION ALL
        SELECT period_start + interval 1 hour, service, '{name}', NULL, false, false
        FROM ({hourly(statistic)}) a
        WHERE NOT EXISTS (SELECT 1 FROM ({hourly(statistic)}) b WHERE b.service = a.service
                          AND b.period_start = a.period_start + interval 1 hour)"""


LIVE_ALARMS = {name: live_alarm(name, a.statistic, a.threshold) for name, a in live.ALARMS.items()}
SQL["live_alarms"] = ("logs", " UNION ALL ".join(f"({text})" for text in LIVE_ALARMS.values()))
SQL["live_composite_alarm"] = ("logs", f"""
    SELECT period_start, bool_or(in_alarm) AS in_alarm
    FROM ({LIVE_ALARMS["average"]} UNION ALL {LIVE_ALARMS["p99"]}) GROUP BY period_start""")
SQL["matches_one_by_one"] = ("shipments invoices", f"""
    SELECT invoice_id, shipment_id,
           CASE WHEN bad <> '' THEN NULL WHEN match_reason IS NULL THEN 'APPROVED'
                WHEN match_reason IN ('OVERCHARGE', 'UNDERCHARGE') THEN 'DISPUTED' ELSE 'MATCHING'
                END AS status,
           CASE WHEN bad <> '' THEN NULL WHEN match_reason IS NULL THEN 'APPROVED'
                ELSE 'DISPUTED' END AS match_outcome,
           CASE WHEN bad = '' THEN match_reason END AS match_reason,
           CASE WHEN bad <> '' THEN concat('no amount: ', bad) END AS error
    FROM (SELECT *, concat_ws(',', CASE WHEN k % 41 = 0 THEN 'invoiced_amount' END,
                                   CASE WHEN k % 43 = 0 THEN 'expected_amount' END) AS bad
          FROM ({matched('''SELECT i.*, s.k, true AS shipment_found FROM invoices i
                             JOIN shipments s ON s.shipment_id = i.shipment_id
                             WHERE s.status = 'DELIVERED' ''')}))""")
SQL["stored_table_audit"] = ("shipments legs invoices incoming", """
    SELECT * FROM (
        SELECT 'dest_city_present' AS rule, count(*) AS rows, 'shipments' AS "table"
        FROM shipments WHERE k % 101 <> 0 AND k % 13 = 0
        UNION ALL
        SELECT 'reference_no_unique', count(*) - count(DISTINCT k % 100), 'shipments'
        FROM shipments WHERE k % 101 <> 0 AND k % 10 = 0
        UNION ALL
        SELECT 'status_known', count(*) + count(*) FILTER (cast(shipment_id AS bigint) % 7 = 0),
               'shipment_legs' FROM legs WHERE suppkey % 5 = 0
        UNION ALL
        SELECT 'shipment_sequence_unique', count(*), 'shipment_legs' FROM legs
        WHERE cast(shipment_id AS bigint) % 7 = 0
        UNION ALL
        SELECT 'shipment_id_exists',
               count(*) + count(*) FILTER (cast(shipment_id AS bigint) % 7 = 0), 'shipment_legs'
        FROM legs WHERE shipment_id NOT IN (SELECT shipment_id FROM shipments WHERE k % 101 <> 0)
        UNION ALL
        SELECT 'currency_present', count(*), 'invoices' FROM invoices
        WHERE cast(shipment_id AS bigint) % 97 <> 0 AND cast(shipment_id AS bigint) % 11 = 0
        UNION ALL
        SELECT 'status_known', count(*), 'invoices' FROM invoices
        WHERE cast(shipment_id AS bigint) % 97 <> 0 AND cast(shipment_id AS bigint) % 17 = 0
        UNION ALL
        SELECT 'description_present', count(*), 'invoice_line_items' FROM incoming
        WHERE cast(split_part(invoice_id, '-', 1) AS bigint) % 19 = 0
        UNION ALL
        SELECT 'invoice_id_exists', count(*), 'invoice_line_items' FROM incoming
        WHERE invoice_id NOT IN (SELECT invoice_id FROM invoices
                                 WHERE cast(shipment_id AS bigint) % 97 <> 0))
    WHERE rows > 0""")
SQL["scorecard_from_days"] = SQL["carrier_scorecard"]
SQL["lanes_from_sketches"] = ("shipments", """
    SELECT carrier_id, count(DISTINCT concat(origin_state, '>', dest_state)) AS distinct_lanes_served,
           true AS within_error
    FROM shipments
    WHERE status IN ('DELIVERED', 'IN_TRANSIT', 'OUT_FOR_DELIVERY')
      AND cast(created_at AS date) BETWEEN date '1993-10-14' AND date '2001-12-31'
    GROUP BY carrier_id, carrier_name""")
SQL["numbers_in_batches"] = ("shipments", """
    SELECT shipment_id, concat('SH-', strftime(created_at, '%Y%m%d'), '-',
               lpad(cast(row_number() OVER (PARTITION BY cast(created_at AS date)
                   ORDER BY k % 3, hour(created_at), substr(md5(shipment_id), 1, 4), shipment_id)
                   AS varchar), 6, '0')) AS reference_number
    FROM shipments""")
SQL["stored_page"] = ("shipments", f"""
    SELECT {DTO} FROM shipments ORDER BY created_at DESC, shipment_id LIMIT 100 OFFSET 13000""")
SQL["search_by_trigrams"] = ("invoices", """
    SELECT invoice_id, invoice_number, status FROM invoices
    WHERE lower(invoice_number) LIKE '%inv-12_4-%'""")
SQL["registered_spend_day"] = ("shipments invoices", cube("1").format(
    where="AND cast(s.created_at AS date) = date '1998-03-15' AND s.s_suppkey % 2 = 0"))
SQL["stored_spend_cube"] = SQL["freight_spend_daily"]
SQL["stored_rates"] = SQL["latest_rate_per_key"]
SQL["stored_messages"] = SQL["created_events"]


def _needed(names: str) -> list[str]:
    """Views in dependency order."""
    found: list[str] = []
    for name in names.split():
        for view in [*_needed(VIEWS[name][0]), name]:
            if view not in found:
                found.append(view)
    return found


def statements() -> dict[str, str]:
    composed = {}
    for name, (views, body) in SQL.items():
        parts = [f"{v} AS ({VIEWS[v][1]})" for v in _needed(views)]
        text = body.strip()
        if text.startswith(","):
            composed[name] = "WITH " + ",\n".join(parts) + text
        elif parts:
            composed[name] = "WITH " + ",\n".join(parts) + "\n" + text
        else:
            composed[name] = text
    return composed
