"""The media-store model: rules, cleaning and dimension shapes of its eleven tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace.operators.cleaning import Day, Text, Treatments
from terrace.operators.dimensions import keyed_dimension, lookup
from terrace.operators.quality import Rule, dated, positive, required
from terrace.operators.scd2 import Versioned

# The source tables.
TABLES = [
    "Album",
    "Artist",
    "Customer",
    "Employee",
    "Genre",
    "Invoice",
    "InvoiceLine",
    "MediaType",
    "Playlist",
    "PlaylistTrack",
    "Track",
]

# The column that divides a table for parallel reads: its own id, or in a table without one
# that of the many.
KEYS = {t: f"{t}Id" for t in TABLES} | {"PlaylistTrack": "TrackId"}

# Mandatory and positive columns per table. The date rules are ours; they
# send unreadable dates to quarantine where a cast would stop the job.
RULES: dict[str, list[Rule]] = {
    "album": required("AlbumId", "Title", "ArtistId"),
    "artist": required("ArtistId"),
    "customer": required("CustomerId", "FirstName", "LastName", "Email", "Country"),
    "employee": required("EmployeeId", "FirstName", "LastName") + dated("BirthDate", "HireDate"),
    "genre": required("GenreId"),
    "invoice": required("InvoiceId", "CustomerId", "InvoiceDate")
    + positive("Total")
    + dated("InvoiceDate"),
    "invoiceline": required("InvoiceLineId", "InvoiceId", "TrackId")
    + positive("UnitPrice", "Quantity"),
    "mediatype": required("MediaTypeId"),
    "playlist": required("PlaylistId"),
    "playlisttrack": required("PlaylistId", "TrackId"),
    "track": required("TrackId", "Name", "MediaTypeId") + positive("Milliseconds", "UnitPrice"),
}

_TRIM, _EMPTY, _UNKNOWN = Text(), Text(default=""), Text(default="Unknown")
_NAMED = {"Name": _UNKNOWN}

# The treatment of every cleaned column.
CLEANING: dict[str, Treatments] = {
    "album": {"Title": _TRIM},
    "artist": _NAMED,
    "customer": {
        **dict.fromkeys(["FirstName", "LastName", "Country"], _TRIM),
        **dict.fromkeys(["Company", "Address", "PostalCode", "Phone", "Fax"], _EMPTY),
        **dict.fromkeys(["City", "State"], _UNKNOWN),
        "Email": Text(lowercase=True),
    },
    "employee": {
        **dict.fromkeys(["FirstName", "LastName"], _TRIM),
        **dict.fromkeys(["Title", "City", "State", "Country"], _UNKNOWN),
        "Phone": _EMPTY,
        "Email": Text(default="", lowercase=True),
        **dict.fromkeys(["BirthDate", "HireDate"], Day()),
    },
    "genre": _NAMED,
    "invoice": {
        "InvoiceDate": Day(),
        **dict.fromkeys(["BillingAddress", "BillingPostalCode"], _EMPTY),
        **dict.fromkeys(["BillingCity", "BillingState", "BillingCountry"], _UNKNOWN),
    },
    "mediatype": _NAMED,
    "playlist": _NAMED,
    "track": {"Name": _TRIM, "Composer": _UNKNOWN},
}

# The versioned customer dimension.
CUSTOMER = Versioned(
    key="customer_key",
    natural="customer_id",
    attributes=[
        "first_name",
        "last_name",
        "company",
        "address",
        "city",
        "state",
        "country",
        "postal_code",
        "phone",
        "fax",
        "email",
        "support_rep_key",
    ],
    tracked=[
        "first_name",
        "last_name",
        "company",
        "address",
        "city",
        "state",
        "country",
        "postal_code",
        "phone",
        "email",
    ],
)


def camel(name: str) -> str:
    """postal_code to PostalCode."""
    return "".join(part.capitalize() for part in name.split("_"))


def _columns(*names: str, **others: str | Column) -> dict[str, str | Column]:
    """Output name to source column; plain names follow the naming rule."""
    return {**{n: camel(n) for n in names}, **others}


def named_dimension(df: DataFrame, entity: str, **options) -> DataFrame:
    """(key, id, name) of an entity such as artist, genre or media_type."""
    key, natural = f"{entity}_key", f"{entity}_id"
    columns = {natural: camel(natural), f"{entity}_name": "Name"}
    return keyed_dimension(df, key, natural, columns, **options)


def album_dimension(albums: DataFrame, artists: DataFrame, **options) -> DataFrame:
    """Albums of known artists; numbered after the join, so orphans use no key."""
    on, take = {"ArtistId": "artist_id"}, {"artist_key": "artist_key"}
    owned = lookup(albums, artists, on, take, "inner")
    columns = _columns("album_id", album_title="Title", artist_key="artist_key")
    return keyed_dimension(owned, "album_key", "album_id", columns, **options)


def employee_dimension(employees: DataFrame, **options) -> DataFrame:
    columns = _columns(
        "employee_id",
        "first_name",
        "last_name",
        full_name=F.concat("FirstName", F.lit(" "), "LastName"),
        title="Title",
        reports_to_id="ReportsTo",
        **_columns("birth_date", "hire_date", "city", "state", "country", "email", "phone"),
    )
    return keyed_dimension(employees, "employee_key", "employee_id", columns, **options)


def track_dimension(
    tracks: DataFrame, albums: DataFrame, media_types: DataFrame, genres: DataFrame, **options
) -> DataFrame:
    """Tracks with the keys of their album, media type and genre, NULL where unmatched.

    Tracks are numbered before the lookups, which keep every track: the passes that find
    the keys then read one column of one table.
    """
    parents = {"album": albums, "media_type": media_types, "genre": genres}
    minutes = F.round(F.col("Milliseconds") / F.lit(60000.0).cast("decimal(6,1)"), 2)
    own = _columns(
        "track_id",
        track_name="Name",
        composer="Composer",
        duration_ms="Milliseconds",
        duration_min=minutes,
        **_columns("bytes", "unit_price"),
    )
    parent_ids = _columns(*[f"{entity}_id" for entity in parents])
    df = keyed_dimension(tracks, "track_key", "track_id", {**own, **parent_ids}, **options)
    for entity, dimension in parents.items():
        natural, key = f"{entity}_id", f"{entity}_key"
        df = lookup(df, dimension, {natural: natural}, {key: key})
    described, measured = list(own)[:2], list(own)[2:]
    return df.select("track_key", *described, *[f"{e}_key" for e in parents], *measured)


def incoming_customers(customers: DataFrame, employees: DataFrame) -> DataFrame:
    """A customer snapshot in dimension shape. Cleaning is applied again, harmlessly."""
    treated = CLEANING["customer"]
    on, take = {"SupportRepId": "employee_id"}, {"support_rep_key": "employee_key"}
    with_rep = lookup(customers, employees, on, take)
    described = [c for c in CUSTOMER.attributes if c != "support_rep_key"]
    return with_rep.select(
        F.col("CustomerId").alias("customer_id"),
        *[treated[camel(c)].applied_to(camel(c)).alias(c) for c in described],
        "support_rep_key",
    )
