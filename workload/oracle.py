"""DuckDB side of the checks: each query as SQL over the provided tables."""

from __future__ import annotations

from workload.roles import MEMBERS, ROLES, SECOND_DAY


def with_tables(select: str, *roles: str, **tables: str) -> str:
    """``select`` over roles (as r_name) and further named subqueries."""
    parts = [f"r_{n} AS ({ROLES[n].sql()})" for n in roles]
    parts += [f"{n} AS ({sql})" for n, sql in tables.items()]
    return f"WITH {', '.join(parts)} {select}"


def _union(*selects: str) -> str:
    return " UNION ALL ".join(selects)


# Rules, as the predicates that must hold.

RULES = {
    "customer": {
        "not_null:CustomerId": "CustomerId IS NOT NULL",
        "not_null:FirstName": "FirstName IS NOT NULL",
        "not_null:LastName": "LastName IS NOT NULL",
        "not_null:Email": "Email IS NOT NULL",
        "not_null:Country": "Country IS NOT NULL",
    },
    "employee": {
        "not_null:EmployeeId": "EmployeeId IS NOT NULL",
        "not_null:FirstName": "FirstName IS NOT NULL",
        "not_null:LastName": "LastName IS NOT NULL",
        "valid_date:BirthDate": "BirthDate IS NULL OR TRY_CAST(BirthDate AS DATE) IS NOT NULL",
        "valid_date:HireDate": "HireDate IS NULL OR TRY_CAST(HireDate AS DATE) IS NOT NULL",
    },
    "invoice": {
        "not_null:InvoiceId": "InvoiceId IS NOT NULL",
        "not_null:CustomerId": "CustomerId IS NOT NULL",
        "not_null:InvoiceDate": "InvoiceDate IS NOT NULL",
        "valid_range:Total": "Total > 0",
    },
    "invoiceline": {
        "not_null:InvoiceLineId": "InvoiceLineId IS NOT NULL",
        "not_null:InvoiceId": "InvoiceId IS NOT NULL",
        "not_null:TrackId": "TrackId IS NOT NULL",
        "valid_range:UnitPrice": "UnitPrice > 0",
        "valid_range:Quantity": "Quantity > 0",
    },
    "track": {
        "not_null:TrackId": "TrackId IS NOT NULL",
        "not_null:Name": "Name IS NOT NULL",
        "not_null:MediaTypeId": "MediaTypeId IS NOT NULL",
        "valid_range:Milliseconds": "Milliseconds > 0",
        "valid_range:UnitPrice": "UnitPrice > 0",
    },
    "artist": {"not_null:ArtistId": "ArtistId IS NOT NULL"},
    "playlisttrack": {
        "not_null:PlaylistId": "PlaylistId IS NOT NULL",
        "not_null:TrackId": "TrackId IS NOT NULL",
    },
    "album": {
        "not_null:AlbumId": "AlbumId IS NOT NULL",
        "not_null:Title": "Title IS NOT NULL",
        "not_null:ArtistId": "ArtistId IS NOT NULL",
    },
    "genre": {"not_null:GenreId": "GenreId IS NOT NULL"},
    "mediatype": {"not_null:MediaTypeId": "MediaTypeId IS NOT NULL"},
    "playlist": {"not_null:PlaylistId": "PlaylistId IS NOT NULL"},
    "extractions": {},
}


def passed(name: str) -> str:
    checks = [f"COALESCE({p}, FALSE)" for p in RULES[name].values()]
    return f"({' AND '.join(checks) or 'TRUE'})"


INVOICE = "* REPLACE (CAST(Total AS DOUBLE) AS Total)"
LINE = "* REPLACE (CAST(UnitPrice AS DOUBLE) AS UnitPrice)"


def _counts(name: str) -> str:
    ok = passed(name)
    return (
        f"SELECT '{name}' AS table_name, count(*) AS total_records,"
        f" count(*) FILTER (WHERE {ok}) AS passed_records,"
        f" count(*) FILTER (WHERE NOT {ok}) AS failed_records FROM r_{name}"
    )


def _by_rule(name: str) -> str:
    return _union(
        *[
            f"SELECT '{label.split(':')[0]}' AS rule, '{label.split(':')[1]}' AS \"column\","
            f" count(*) FILTER (WHERE NOT COALESCE({p}, FALSE)) AS violations FROM r_{name}"
            for label, p in RULES[name].items()
        ]
    )


def _violations(name: str, columns: str) -> str:
    return _union(
        *[
            f"SELECT {columns}, '{label.split(':')[0]}' AS failed_rule,"
            f" '{label.split(':')[1]}' AS failed_column"
            f" FROM r_{name} WHERE NOT COALESCE({p}, FALSE)"
            for label, p in RULES[name].items()
        ]
    )


def _reasons(name: str, part: int | None) -> str:
    """The broken rules of a row joined by commas: whole labels, or one part of them."""
    shown = [
        (label if part is None else label.split(":")[part], p) for label, p in RULES[name].items()
    ]
    cases = ", ".join(
        f"CASE WHEN NOT COALESCE({p}, FALSE) THEN '{text}' END" for text, p in shown
    )
    return f"concat_ws(',', {cases})"


# Cleaning


def trimmed(column: str, default: str | None = None) -> str:
    return f"trim({column})" if default is None else f"trim(COALESCE({column}, '{default}'))"


def replaced(source: str, **expressions: str) -> str:
    changes = ", ".join(f"{e} AS {c}" for c, e in expressions.items())
    return f"SELECT * REPLACE ({changes}) FROM {source}"


CLEAN_CUSTOMER = {
    **{c: trimmed(c) for c in ("FirstName", "LastName", "Country")},
    **{c: trimmed(c, "") for c in ("Company", "Address", "PostalCode", "Phone", "Fax")},
    **{c: trimmed(c, "Unknown") for c in ("City", "State")},
    "Email": "lower(trim(Email))",
}
CLEAN_INVOICE = {
    "InvoiceDate": "CAST(InvoiceDate AS DATE)",
    **{c: trimmed(c, "") for c in ("BillingAddress", "BillingPostalCode")},
    **{c: trimmed(c, "Unknown") for c in ("BillingCity", "BillingState", "BillingCountry")},
}
CLEAN_EMPLOYEE = {
    **{c: trimmed(c) for c in ("FirstName", "LastName")},
    **{c: trimmed(c, "Unknown") for c in ("Title", "City", "State", "Country")},
    "Email": "lower(trim(COALESCE(Email, '')))",
    "Phone": trimmed("Phone", ""),
    "BirthDate": "TRY_CAST(BirthDate AS DATE)",
    "HireDate": "TRY_CAST(HireDate AS DATE)",
}
CLEAN_TRACK = {"Name": trimmed("Name"), "Composer": trimmed("Composer", "Unknown")}


def _clean_name(entity: str, natural: str) -> str:
    name = trimmed("Name", "Unknown")
    return (
        f"SELECT '{entity}' AS entity, CAST({natural} AS VARCHAR) AS id, {name} AS name"
        f" FROM r_{entity}"
    )


# Dimensions


def numbered(order: str) -> str:
    return f"CAST(row_number() OVER (ORDER BY {order} NULLS FIRST) AS INT)"


def dim_date(source: str) -> str:
    return (
        "SELECT CAST(strftime(d, '%Y%m%d') AS INT) AS date_key, d AS full_date,"
        " CAST(year(d) AS INT) AS year, CAST(quarter(d) AS INT) AS quarter,"
        " CAST(month(d) AS INT) AS month, monthname(d) AS month_name,"
        " CAST(day(d) AS INT) AS day, CAST(dayofweek(d) + 1 AS INT) AS day_of_week,"
        " dayname(d) AS day_name,"
        " CASE WHEN dayofweek(d) IN (0, 6) THEN 'Y' ELSE 'N' END AS is_weekend"
        f" FROM (SELECT DISTINCT CAST(InvoiceDate AS DATE) AS d FROM {source}"
        " WHERE InvoiceDate IS NOT NULL)"
    )


def dim_named(source: str, entity: str, natural: str) -> str:
    return (
        f"SELECT {numbered(natural)} AS {entity}_key, {natural} AS {entity}_id,"
        f" Name AS {entity}_name FROM {source}"
    )


def dim_album(source: str) -> str:
    return (
        f"SELECT {numbered('AlbumId')} AS album_key, AlbumId AS album_id,"
        f" Title AS album_title, artist_key"
        f" FROM {source} JOIN dim_artist ON ArtistId = artist_id"
    )


def dim_employee(source: str) -> str:
    return (
        f"SELECT {numbered('EmployeeId')} AS employee_key, EmployeeId AS employee_id,"
        " FirstName AS first_name, LastName AS last_name,"
        " FirstName || ' ' || LastName AS full_name, Title AS title,"
        " ReportsTo AS reports_to_id, BirthDate AS birth_date, HireDate AS hire_date,"
        " City AS city, State AS state, Country AS country, Email AS email, Phone AS phone"
        f" FROM {source}"
    )


def dim_track(source: str) -> str:
    minutes = "(2 * Milliseconds * 100 + 60000) // 120000 / 100.0"
    return (
        f"SELECT {numbered('TrackId')} AS track_key, TrackId AS track_id, Name AS track_name,"
        " album_key, media_type_key, genre_key, Composer AS composer,"
        f" Milliseconds AS duration_ms, CAST({minutes} AS DOUBLE) AS duration_min,"
        " Bytes AS bytes, CAST(UnitPrice AS DOUBLE) AS unit_price"
        f" FROM {source} LEFT JOIN dim_album ON AlbumId = album_id"
        " LEFT JOIN dim_media_type ON MediaTypeId = media_type_id"
        " LEFT JOIN dim_genre ON GenreId = genre_id"
    )


def dim_customer(source: str) -> str:
    texts = {
        "first_name": trimmed("FirstName"),
        "last_name": trimmed("LastName"),
        "company": trimmed("Company", ""),
        "address": trimmed("Address", ""),
        "city": trimmed("c.City", "Unknown"),
        "state": trimmed("c.State", "Unknown"),
        "country": trimmed("c.Country"),
        "postal_code": trimmed("PostalCode", ""),
        "phone": trimmed("c.Phone", ""),
        "fax": trimmed("Fax", ""),
        "email": "lower(trim(c.Email))",
    }
    columns = ", ".join(f"{e} AS {n}" for n, e in texts.items())
    return (
        f"SELECT {numbered('CustomerId')} AS customer_key, CustomerId AS customer_id, {columns},"
        " employee_key AS support_rep_key, DATE '2002-01-01' AS effective_start_date,"
        " CAST(NULL AS DATE) AS effective_end_date, TRUE AS is_current"
        f" FROM {source} c LEFT JOIN dim_employee ON SupportRepId = employee_id"
    )


STAR_ROLES = ("artist", "album", "genre", "mediatype", "track", "employee", "customer", "invoice")


def star(select: str, **more: str) -> str:
    """``select`` over all dimensions built straight from the roles."""
    return with_tables(
        select,
        *STAR_ROLES,
        "invoiceline",
        clean_employee=replaced("r_employee", **CLEAN_EMPLOYEE),
        dim_artist=dim_named("r_artist", "artist", "ArtistId"),
        dim_album=dim_album("r_album"),
        dim_genre=dim_named("r_genre", "genre", "GenreId"),
        dim_media_type=dim_named("r_mediatype", "media_type", "MediaTypeId"),
        dim_employee=dim_employee("clean_employee"),
        dim_track=dim_track("r_track"),
        dim_customer=dim_customer("r_customer"),
        dim_date=dim_date("r_invoice"),
        **more,
    )


def fact(lines: str, invoices: str) -> str:
    return (
        "SELECT InvoiceLineId AS invoice_line_id, il.InvoiceId AS invoice_id, customer_key,"
        " date_key, track_key, album_key, genre_key, media_type_key, employee_key,"
        " CAST(il.UnitPrice AS DOUBLE) AS unit_price, Quantity AS quantity,"
        " CAST(il.UnitPrice * Quantity AS DOUBLE) AS line_total,"
        " CAST(il.UnitPrice * 100 AS BIGINT) * Quantity AS cents,"
        " BillingCity AS billing_city, BillingCountry AS billing_country"
        f" FROM {lines} il JOIN {invoices} inv ON il.InvoiceId = inv.InvoiceId"
        " JOIN dim_customer ON inv.CustomerId = customer_id AND is_current"
        " JOIN dim_date ON CAST(InvoiceDate AS DATE) = full_date"
        " JOIN dim_track ON il.TrackId = track_id"
        " LEFT JOIN dim_employee ON support_rep_key = employee_key"
    )


def totals(source: str) -> str:
    sixth = "(2 * s * 10000 + n) // (2 * n)"
    return (
        "SELECT customer_key, employee_key, total_invoices, n AS total_line_items,"
        " total_quantity, CAST(s / 100.0 AS DOUBLE) AS total_revenue,"
        f" CAST((2 * ({sixth}) + 10000) // 20000 / 100.0 AS DOUBLE) AS avg_line_total,"
        " max_line_total, first_purchase_date_key, last_purchase_date_key"
        " FROM (SELECT customer_key, max(employee_key) AS employee_key,"
        " count(DISTINCT invoice_id) AS total_invoices, count(*) AS n,"
        " CAST(sum(quantity) AS BIGINT) AS total_quantity, CAST(sum(cents) AS BIGINT) AS s,"
        " max(line_total) AS max_line_total, min(date_key) AS first_purchase_date_key,"
        f" max(date_key) AS last_purchase_date_key FROM {source} GROUP BY customer_key)"
    )


def refreshed() -> str:
    """The star schema when every source first passes the rules and is cleaned."""

    def silver(name: str, **cleaned: str) -> str:
        source = f"(SELECT * FROM r_{name} WHERE {passed(name)})"
        return replaced(source, **cleaned) if cleaned else f"SELECT * FROM {source}"

    return with_tables(
        totals("fact"),
        *STAR_ROLES,
        "invoiceline",
        s_artist=replaced("r_artist", Name=trimmed("Name", "Unknown")),
        s_album=replaced("r_album", Title="trim(Title)"),
        s_employee=silver("employee", **CLEAN_EMPLOYEE),
        s_customer=silver("customer", **CLEAN_CUSTOMER),
        s_invoice=silver("invoice", **CLEAN_INVOICE),
        s_line=silver("invoiceline"),
        s_track=silver("track", **CLEAN_TRACK),
        dim_artist=dim_named("s_artist", "artist", "ArtistId"),
        dim_album=dim_album("s_album"),
        dim_genre=dim_named("r_genre", "genre", "GenreId"),
        dim_media_type=dim_named("r_mediatype", "media_type", "MediaTypeId"),
        dim_employee=dim_employee("s_employee"),
        dim_track=dim_track("s_track"),
        dim_customer=dim_customer("s_customer"),
        dim_date=dim_date("s_invoice"),
        fact=fact("s_line", "s_invoice"),
    )


# Versioned dimension

VERSION = (
    "customer_key, customer_id, name, segment, nation, balance,"
    " effective_start_date, effective_end_date, is_current"
)
DIFFERS = " OR ".join(
    f"{{a}}.{c} IS DISTINCT FROM {{b}}.{c}" for c in ("name", "segment", "nation")
)
CHANGED = "DATE '2002-03-01'"


def versioned(select: str) -> str:
    """``select`` over v1 (first load), closed, opened, v2 (after the update) and m3."""
    opened = (
        f"SELECT CAST((SELECT max(customer_key) FROM v1) + {numbered('m.customer_id')} AS INT)"
        " AS customer_key, m.customer_id, m.name, m.segment, m.nation, m.balance,"
        f" {CHANGED} AS effective_start_date, CAST(NULL AS DATE) AS effective_end_date,"
        " TRUE AS is_current FROM m2 m LEFT JOIN v1 ON m.customer_id = v1.customer_id"
        f" WHERE v1.customer_id IS NULL OR {DIFFERS.format(a='m', b='v1')}"
    )
    hit = f"m.customer_id IS NOT NULL AND ({DIFFERS.format(a='m', b='v1')})"
    closed = (
        "SELECT v1.customer_key, v1.customer_id, v1.name, v1.segment, v1.nation, v1.balance,"
        f" v1.effective_start_date, CAST(CASE WHEN {hit} THEN {CHANGED} - 1 END AS DATE)"
        f" AS effective_end_date, NOT ({hit}) AS is_current"
        " FROM v1 LEFT JOIN m2 m ON m.customer_id = v1.customer_id"
    )
    first = (
        f"SELECT {numbered('customer_id')} AS customer_key, *,"
        " DATE '2002-01-01' AS effective_start_date, CAST(NULL AS DATE) AS effective_end_date,"
        " TRUE AS is_current FROM m1"
    )
    return with_tables(
        select,
        m1=MEMBERS[0].sql(),
        m2=MEMBERS[1].sql(),
        m3=MEMBERS[2].sql(),
        v1=first,
        closed=closed,
        opened=opened,
        v2=f"SELECT {VERSION} FROM closed UNION ALL SELECT {VERSION} FROM opened",
    )


def same_day() -> str:
    """The third snapshot: versions opened that day are amended, older ones superseded."""
    differs = f"m.customer_id IS NOT NULL AND v2.is_current AND ({DIFFERS.format(a='m', b='v2')})"
    amend = f"({differs} AND v2.effective_start_date >= {CHANGED})"
    close = f"({differs} AND v2.effective_start_date < {CHANGED})"
    merged = ", ".join(
        f"CASE WHEN {amend} THEN m.{c} ELSE v2.{c} END AS {c}"
        for c in ("name", "segment", "nation", "balance")
    )
    kept = (
        f"SELECT v2.customer_key, v2.customer_id, {merged}, v2.effective_start_date,"
        f" CAST(CASE WHEN {close} THEN {CHANGED} - 1 ELSE v2.effective_end_date END AS DATE)"
        f" AS effective_end_date, v2.is_current AND NOT {close} AS is_current"
        " FROM v2 LEFT JOIN m3 m ON m.customer_id = v2.customer_id"
    )
    added = (
        f"SELECT CAST((SELECT max(customer_key) FROM v2) + {numbered('m.customer_id')} AS INT)"
        " AS customer_key, m.customer_id, m.name, m.segment, m.nation, m.balance,"
        f" {CHANGED} AS effective_start_date, CAST(NULL AS DATE) AS effective_end_date,"
        " TRUE AS is_current FROM m3 m"
        " LEFT JOIN (SELECT * FROM v2 WHERE is_current) v2 ON m.customer_id = v2.customer_id"
        f" WHERE v2.customer_id IS NULL OR {close}"
    )
    return versioned(f"SELECT {VERSION} FROM ({kept}) UNION ALL SELECT {VERSION} FROM ({added})")


def _dropped() -> str:
    lines = "SELECT count(*) FROM r_invoiceline il WHERE"
    reasons = {
        "no invoice": "NOT EXISTS (SELECT 1 FROM r_invoice i WHERE i.InvoiceId = il.InvoiceId)",
        "no track": "NOT EXISTS (SELECT 1 FROM r_track t WHERE t.TrackId = il.TrackId)",
        "no customer": "EXISTS (SELECT 1 FROM r_invoice i WHERE i.InvoiceId = il.InvoiceId AND"
        " NOT EXISTS (SELECT 1 FROM r_customer c WHERE c.CustomerId = i.CustomerId))",
        "no date": "EXISTS (SELECT 1 FROM r_invoice i WHERE i.InvoiceId = il.InvoiceId"
        " AND i.InvoiceDate IS NULL)",
    }
    selects = [f"SELECT '{r}' AS reason, ({lines} {c}) AS dropped" for r, c in reasons.items()]
    return with_tables(_union(*selects), "invoiceline", "invoice", "track", "customer")


FACT_COLUMNS = (
    "invoice_line_id, invoice_id, customer_key, date_key, track_key, album_key, genre_key,"
    " media_type_key, employee_key, unit_price, quantity, line_total, billing_city,"
    " billing_country"
)
SOURCE_TABLES = (
    "album artist customer employee genre invoice invoiceline mediatype playlist playlisttrack track"
).split()


def _reconciled(name: str, source: str, target: str) -> str:
    return (
        f"SELECT '{name}' AS table_name, s AS source_row_count, t AS target_row_count,"
        " CASE WHEN s = t THEN 'SUCCESS' ELSE 'FAILED' END AS status"
        f" FROM (SELECT ({source}) AS s, ({target}) AS t)"
    )


def _duplicates() -> str:
    twice = "(SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem)"
    frames = {
        "lines": "lineitem",
        "lines twice": twice,
        "order positions": "(SELECT l_orderkey, l_linenumber FROM lineitem)",
        "flags": "(SELECT l_returnflag, l_linestatus FROM lineitem)",
    }
    return _union(
        *[
            f"SELECT '{n}' AS table_name, (SELECT count(*) FROM {t})"
            f" - (SELECT count(*) FROM (SELECT DISTINCT * FROM {t})) AS duplicates"
            for n, t in frames.items()
        ]
    )


def _nulls(name: str) -> str:
    return with_tables(
        _union(
            *[
                f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS nulls, count(*) AS total"
                f" FROM r_{name}"
                for c in ROLES[name].columns
            ]
        ),
        name,
    )


def _twice_customers() -> str:
    """Versions after two days: v1 from the first; changed and new members opened on the second."""
    first = {"FirstName": trimmed("FirstName")}
    opened = (
        "SELECT CAST((SELECT max(customer_key) FROM v1)"
        " + row_number() OVER (ORDER BY m.CustomerId) AS INT) AS customer_key,"
        " m.CustomerId AS customer_id, m.FirstName AS first_name,"
        f" {CHANGED} AS effective_start_date, CAST(NULL AS DATE) AS effective_end_date,"
        " TRUE AS is_current FROM later m LEFT JOIN v1 ON v1.customer_id = m.CustomerId"
        " WHERE v1.customer_id IS NULL OR v1.first_name <> m.FirstName"
    )
    kept = (
        "SELECT customer_key, customer_id, first_name, DATE '2002-01-01' AS effective_start_date,"
        f" CAST(CASE WHEN m.FirstName <> first_name THEN {CHANGED} - 1 END AS DATE)"
        " AS effective_end_date, COALESCE(m.FirstName = first_name, TRUE) AS is_current"
        " FROM v1 LEFT JOIN later m ON v1.customer_id = m.CustomerId"
    )
    ok = passed("customer")
    return (
        f"WITH r_customer AS ({ROLES['customer'].sql()}),"
        f" r_later AS ({SECOND_DAY['customer'].sql()}),"
        f" early AS ({replaced(f'(SELECT * FROM r_customer WHERE {ok})', **first)}),"
        f" later AS ({replaced(f'(SELECT * FROM r_later WHERE {ok})', **first)}),"
        f" v1 AS (SELECT {numbered('CustomerId')} AS customer_key, CustomerId AS customer_id,"
        " FirstName AS first_name FROM early),"
        f" versions AS ({kept} UNION ALL {opened}) "
    )


def _twice_fact() -> str:
    lines = f"(SELECT * FROM ({SECOND_DAY['invoiceline'].sql()}) WHERE {passed('invoiceline')})"
    invoices = f"(SELECT * FROM ({ROLES['invoice'].sql()}) WHERE {passed('invoice')})"
    tracks = (
        f"(SELECT TrackId, {numbered('TrackId')} AS track_key"
        f" FROM ({ROLES['track'].sql()}) WHERE {passed('track')})"
    )
    return (
        "SELECT InvoiceLineId AS invoice_line_id, customer_key, track_key,"
        f" CAST(UnitPrice * Quantity AS DOUBLE) AS line_total FROM {lines} l"
        f" JOIN {tracks} t ON l.TrackId = t.TrackId JOIN {invoices} i ON l.InvoiceId = i.InvoiceId"
        " JOIN versions ON i.CustomerId = customer_id AND is_current"
    )


def _days(select: str) -> str:
    """``select`` for each source table and day; {role}, {day} and {ok} are filled in."""
    parts = []
    for day, later in (("2002-01-01", False), ("2002-03-01", True)):
        for name in SOURCE_TABLES:
            source = SECOND_DAY.get(name, ROLES[name]) if later else ROLES[name]
            ok = passed(name) if name in RULES else "(TRUE)"
            parts.append(select.format(role=f"({source.sql()})", day=day, ok=ok, name=name))
    return _union(*parts)


def _third_day(select: str) -> str:
    """``select`` for each source table on the day on which two cannot be read."""
    parts = []
    for name in SOURCE_TABLES:
        read = name not in ("genre", "playlist")
        status, rows = ("SUCCESS", "count(*)") if read else ("FAILED", "count(*) * 0")
        parts.append(select.format(name=name, role=f"({ROLES[name].sql()})", status=status, rows=rows))
    return _union(*parts)


def _profile_log() -> str:
    parts = []
    for name in SOURCE_TABLES:
        source = f"({ROLES[name].sql()})"
        repeated = f"(SELECT count(*) FROM {source}) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {source}))"
        parts += [
            f"SELECT '{name}' AS table_name, '{c}' AS column_name, count(*) - count({c}) AS null_count,"
            f" {repeated} AS duplicate_rows FROM {source}"
            for c in ROLES[name].columns
        ]
    return _union(*parts)


ORACLE: dict[str, str] = {
    "active_sources": with_tables("SELECT * FROM r_sourcelist WHERE active_flag = 'Y'", "sourcelist"),
    "latest_snapshot": with_tables(
        "SELECT table_name, file_location, execution_time,"
        " CAST(DATE '2002-01-01' - CAST(execution_time AS DATE) AS INT) AS snapshot_age FROM ("
        "SELECT *, row_number() OVER (PARTITION BY table_name"
        " ORDER BY execution_time DESC, file_location DESC) AS rn FROM r_extractions"
        " WHERE status = 'SUCCESS') WHERE rn = 1 AND table_name IN"
        " (SELECT table_name FROM r_sourcelist WHERE active_flag = 'Y')",
        "extractions",
        "sourcelist",
    ),
    "snapshot_copy": "SELECT * FROM orders",
    "reconcile_counts": with_tables(
        _union(
            _reconciled(
                "lines",
                "SELECT count(*) FROM lineitem",
                f"SELECT count(*) FROM r_invoiceline WHERE {passed('invoiceline')}",
            ),
            _reconciled(
                "invoices",
                "SELECT count(*) FROM r_invoice",
                f"SELECT count(*) FROM r_invoice WHERE {passed('invoice')}",
            ),
            _reconciled("snapshot", "SELECT count(*) FROM r_invoice", "SELECT count(*) FROM orders"),
        ),
        "invoice",
        "invoiceline",
    ),
    "profile_nulls": _nulls("invoice"),
    "profile_duplicates": _duplicates(),
    "rules_pass": with_tables(
        f"SELECT {INVOICE} FROM r_invoice WHERE {passed('invoice')}", "invoice"
    ),
    "rules_fail": with_tables(
        f"SELECT {INVOICE} FROM r_invoice WHERE NOT {passed('invoice')}", "invoice"
    ),
    "rules_summary": with_tables(_union(*map(_counts, RULES)), *RULES),
    "rules_by_rule": with_tables(_by_rule("invoiceline"), "invoiceline"),
    "rules_violations": with_tables(_violations("invoiceline", LINE), "invoiceline"),
    "quarantine_rows": with_tables(
        "SELECT 'invoiceline' AS table_name, '2002-01-01 06:00:00' AS execution_time,"
        f" {_reasons('invoiceline', None)} AS failed_rule,"
        f" {_reasons('invoiceline', 1)} AS failed_column, InvoiceLineId AS line_id,"
        f" DATE '2002-01-01' AS created_date FROM r_invoiceline WHERE NOT {passed('invoiceline')}",
        "invoiceline",
    ),
    "quarantine_restored": with_tables(
        f"SELECT {LINE} FROM r_invoiceline WHERE NOT {passed('invoiceline')}", "invoiceline"
    ),
    "clean_customer": with_tables(replaced("r_customer", **CLEAN_CUSTOMER), "customer"),
    "clean_orders": with_tables(
        replaced("r_invoice", **CLEAN_INVOICE, Total="CAST(Total AS DOUBLE)"), "invoice"
    ),
    "clean_supplier": with_tables(replaced("r_employee", **CLEAN_EMPLOYEE), "employee"),
    "clean_names": with_tables(
        _union(
            _clean_name("artist", "ArtistId"),
            _clean_name("genre", "GenreId"),
            _clean_name("mediatype", "MediaTypeId"),
            _clean_name("playlist", "PlaylistId"),
        ),
        "artist",
        "genre",
        "mediatype",
        "playlist",
    ),
    "clean_titles": with_tables(replaced("r_album", Title="trim(Title)"), "album"),
    "clean_part": with_tables(
        replaced("r_track", **CLEAN_TRACK, UnitPrice="CAST(UnitPrice AS DOUBLE)"), "track"
    ),
    "clean_unlisted": with_tables(f"SELECT {LINE} FROM r_invoiceline", "invoiceline"),
    "dim_date": star("SELECT * FROM dim_date"),
    "dim_region": star("SELECT * FROM dim_artist"),
    "dim_part_type": star("SELECT * FROM dim_genre"),
    "dim_brand": star("SELECT * FROM dim_media_type"),
    "dim_nation": star("SELECT * FROM dim_album"),
    "dim_supplier": star("SELECT * FROM dim_employee"),
    "dim_part": star("SELECT * FROM dim_track"),
    "keys_in_buckets": f"SELECT {numbered('o_orderkey')} AS order_key, o_orderkey, o_custkey FROM orders",
    "keys_for_copies": f"SELECT {numbered('natural_id')} AS surrogate, natural_id FROM"
    " (SELECT CASE WHEN o_orderkey % 3 = 0 THEN -5 ELSE o_orderkey END AS natural_id FROM orders)",
    "keys_extended": "SELECT CAST(row_number() OVER"
    " (ORDER BY CASE WHEN p_partkey % 2 = 1 THEN 0 ELSE 1 END, p_partkey) AS INT) AS part_key,"
    " p_partkey, p_brand FROM part",
    "scd2_initial": star("SELECT * FROM dim_customer"),
    "scd2_expired": versioned(f"SELECT {VERSION} FROM v2 WHERE NOT is_current"),
    "scd2_inserted": versioned(f"SELECT {VERSION} FROM opened"),
    "scd2_full": versioned(f"SELECT {VERSION} FROM v2"),
    "scd2_same_day": same_day(),
    "scd2_current": versioned(f"SELECT {VERSION} FROM v2 WHERE is_current"),
    "scd2_counts": versioned(
        "SELECT count(*) AS total_rows, count(*) FILTER (WHERE is_current) AS current_rows FROM v2"
    ),
    "fact_sales": star(
        f"SELECT {FACT_COLUMNS} FROM fact", fact=fact("r_invoiceline", "r_invoice")
    ),
    "fact_customer_agg": star(totals("fact"), fact=fact("r_invoiceline", "r_invoice")),
    "fact_dropped": _dropped(),
    "layer_row_counts": with_tables(
        _union(
            *[
                f"SELECT '{n}' AS table_name, count(*) AS row_count FROM r_{n}"
                for n in SOURCE_TABLES
            ]
        ),
        *SOURCE_TABLES,
    ),
    "run_summary": with_tables(
        "SELECT status, count(DISTINCT table_name) AS tables, count(*) AS runs,"
        " CAST(sum(target_row_count) AS BIGINT) AS row_count FROM r_extractions GROUP BY status",
        "extractions",
    ),
    "quality_summary": with_tables(
        "SELECT table_name, count(*) AS runs, CAST(sum(total_records) AS BIGINT) AS total_records,"
        " CAST(sum(passed_records) AS BIGINT) AS passed_records,"
        " CAST(sum(failed_records) AS BIGINT) AS failed_records FROM r_checks GROUP BY table_name",
        "checks",
    ),
    "refreshed_customer_totals": refreshed(),
    "refreshed_twice_customers": f"{_twice_customers()} SELECT * FROM versions",
    "refreshed_twice_fact": f"{_twice_customers()} {_twice_fact()}",
    "refreshed_logs": _days(
        "SELECT '{name}' AS table_name, DATE '{day}' AS created_date, count(*) AS total_records,"
        " count(*) FILTER (WHERE {ok}) AS passed_records,"
        " count(*) FILTER (WHERE NOT {ok}) AS failed_records FROM {role}"
    ),
    "refreshed_quarantine": "SELECT * FROM ("
    + _days(
        "SELECT '{name}' AS table_name, DATE '{day}' AS created_date,"
        " count(*) FILTER (WHERE NOT {ok}) AS rejected FROM {role}"
    )
    + ") WHERE rejected > 0",
    "refreshed_extractions": "SELECT *, table_name || '.csv' AS file_name, 'Y' AS active_flag FROM ("
    + _union(
        _days(
            "SELECT '{name}' AS table_name, DATE '{day}' AS created_date, 'SUCCESS' AS status,"
            " count(*) AS source_row_count, count(*) AS target_row_count FROM {role}"
        ),
        _third_day(
            "SELECT '{name}' AS table_name, DATE '2002-03-02' AS created_date, '{status}' AS status,"
            " {rows} AS source_row_count, {rows} AS target_row_count FROM {role}"
        ),
    )
    + ")",
    "refreshed_stage_log": _union(
        *[
            _days(
                f"SELECT '{stage}' AS stage, '{{name}}' AS table_name, DATE '{{day}}' AS created_date,"
                f" 'SUCCESS' AS status, count(*){kept} AS row_count FROM {{role}}"
            )
            for stage, kept in (("extract", ""), ("bronze", ""), ("silver", " FILTER (WHERE {ok})"))
        ],
        _third_day(
            "SELECT 'extract' AS stage, '{name}' AS table_name, DATE '2002-03-02' AS created_date,"
            " '{status}' AS status, {rows} AS row_count FROM {role}"
        ),
    ),
    "profile_log": _profile_log(),
    "keys_extended_repeats": "WITH p AS (SELECT CASE WHEN p_partkey % 50 <> 0 THEN p_partkey % 40 END"
    " AS natural_id, p_partkey % 2 = 1 AS known FROM part)"
    f" SELECT natural_id, {numbered('natural_id')} AS part_key FROM p WHERE known"
    " UNION ALL SELECT natural_id, CAST((SELECT count(*) FROM p WHERE known)"
    f" + {numbered('natural_id')} AS INT) FROM p WHERE NOT known",
    "keys_after_leavers": "WITH first AS (SELECT p_partkey,"
    f" {numbered('p_partkey')} AS part_key FROM part), fresh AS ("
    "SELECT p_partkey FROM part WHERE p_partkey % 10 <> 0 AND p_partkey % 7 <> 0 AND p_partkey % 3 = 0"
    " UNION ALL SELECT -p_partkey FROM part WHERE p_partkey % 7 = 0)"
    " SELECT p_partkey, part_key FROM first"
    " WHERE p_partkey % 10 <> 0 AND p_partkey % 7 <> 0 AND p_partkey % 3 <> 0"
    " UNION ALL SELECT p_partkey, CAST((SELECT count(*) FROM part)"
    f" + {numbered('p_partkey')} AS INT) FROM fresh",
    "line_totals": "SELECT l_orderkey, l_linenumber, CAST(round("
    "CAST(l_partkey % 9973 * CAST(0.005005 AS DECIMAL(7,6)) AS DECIMAL(14,6)) * CAST(l_quantity AS INT), 2)"
    " AS DOUBLE) AS exact_total, CAST(round(l_partkey / 7.0::DOUBLE * CAST(l_quantity AS INT), 2)"
    " AS DOUBLE) AS binary_total FROM lineitem",
    "rules_with_clashing_names": with_tables(
        _union(
            *[
                "SELECT CAST(InvoiceLineId AS BIGINT) AS line_id, CAST(UnitPrice AS DOUBLE) AS price,"
                f" CAST(Quantity AS BIGINT) AS violation, '{rule}' AS failed_rule,"
                f" '{column}' AS failed_column FROM r_invoiceline WHERE NOT COALESCE({holds}, FALSE)"
                for rule, column, holds in (
                    ("valid_range", "violation", "Quantity > 0"),
                    ("valid_range", "unit.price", "UnitPrice > 0"),
                    ("not_null", "copies", "TrackId IS NOT NULL"),
                )
            ],
            "SELECT NULL, NULL, count(*) - (SELECT count(*) FROM (SELECT DISTINCT InvoiceLineId, UnitPrice,"
            " Quantity, TrackId FROM r_invoiceline)) + count(*), 'duplicates', '' FROM r_invoiceline",
        ),
        "invoiceline",
    ),
}
ORACLE["scd2_with_clashing_names"] = ORACLE["scd2_full"]
