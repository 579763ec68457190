"""Small dirty source tables of the media store, in three daily versions."""

from __future__ import annotations

from datetime import datetime
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession

SCHEMAS = {
    "Artist": "ArtistId int, Name string",
    "Album": "AlbumId int, Title string, ArtistId int",
    "Genre": "GenreId int, Name string",
    "MediaType": "MediaTypeId int, Name string",
    "Track": "TrackId int, Name string, AlbumId int, MediaTypeId int, GenreId int,"
    " Composer string, Milliseconds int, Bytes int, UnitPrice decimal(10,2)",
    "Employee": "EmployeeId int, LastName string, FirstName string, Title string, ReportsTo int,"
    " BirthDate timestamp, HireDate timestamp, City string, State string, Country string,"
    " Phone string, Email string",
    "Customer": "CustomerId int, FirstName string, LastName string, Company string,"
    " Address string, City string, State string, Country string, PostalCode string,"
    " Phone string, Fax string, Email string, SupportRepId int",
    "Invoice": "InvoiceId int, CustomerId int, InvoiceDate timestamp, BillingAddress string,"
    " BillingCity string, BillingState string, BillingCountry string,"
    " BillingPostalCode string, Total decimal(10,2)",
    "InvoiceLine": "InvoiceLineId int, InvoiceId int, TrackId int, UnitPrice decimal(10,2),"
    " Quantity int",
    "Playlist": "PlaylistId int, Name string",
    "PlaylistTrack": "PlaylistId int, TrackId int",
}

D = Decimal
BORN, HIRED = datetime(1970, 5, 1), datetime(2002, 8, 14)
DAY = datetime(2021, 2, 6, 10, 30)  # a Saturday


def employee(number: int, first: str = " Ann ", boss: int | None = None) -> tuple:
    return (number, "Peck", first, None, boss, BORN, HIRED, None, "AB", "CA", None, " A@X.org ")


def customer(number: int, **changes) -> tuple:
    row = dict(
        CustomerId=number,
        FirstName=" Eva ",
        LastName="Ros",
        Company=None,
        Address="Main 1",
        City="Oslo",
        State=None,
        Country="NO",
        PostalCode="0171",
        Phone="+47",
        Fax=None,
        Email=f" C{number}@Mail.ORG ",
        SupportRepId=3,
    )
    row.update(changes)
    return tuple(row.values())


def invoice(number: int, customer_id: int | None, total, day=DAY) -> tuple:
    return (number, customer_id, day, None, "Oslo", "  ", None, None, total)


ROWS: dict[str, list[tuple]] = {
    "Artist": [(1, " AC "), (2, None), (5, "Solo")],
    "Album": [(10, " First ", 1), (11, "Second", 2), (12, "Orphan", 99), (13, None, 1)],
    "Genre": [(1, "Rock"), (2, "  ")],
    "MediaType": [(1, "MPEG"), (2, None)],
    "Track": [
        (100, " One ", 10, 1, 1, None, 343719, 11170334, D("0.99")),
        (101, "Two", None, 2, 2, " Bo ", 200000, None, D("1.99")),
        (102, "Three", 12, 1, None, "C", 60000, 5, D("0.50")),
        (103, None, 10, 1, 1, None, 60000, 5, D("0.50")),
        (104, "Silent", 10, 1, 1, None, None, 5, D("0.50")),
    ],
    "Employee": [employee(2), employee(3, "Bob", 2), employee(4, None)],
    "Customer": [
        customer(1),
        customer(2, City="  ", SupportRepId=None),
        customer(3, Phone=None),
        customer(4),
        customer(5),
        customer(6, SupportRepId=2),
        customer(7, Email=None),
    ],
    "Invoice": [
        invoice(1, 1, D("3.96")),
        invoice(2, 2, D("1.99"), datetime(2021, 2, 7)),
        invoice(3, 3, None),
        invoice(4, 3, D("0.00")),
        invoice(5, 4, D("-1.00")),
        invoice(6, 99, D("5.00")),
        invoice(7, 6, D("2.00"), None),
        invoice(8, 6, D("1.00"), datetime(2021, 3, 1)),
    ],
    "InvoiceLine": [
        (1, 1, 100, D("0.99"), 2),
        (2, 1, 101, D("1.99"), 1),
        (3, 2, 101, D("1.99"), 1),
        (4, 3, 100, D("0.99"), 1),
        (5, 6, 100, D("0.99"), 1),
        (6, 77, 100, D("0.99"), 1),
        (7, 8, 103, D("0.50"), 1),
        (8, 8, None, D("0.50"), 0),
        (9, 8, 102, D("0.50"), 3),
        (10, 8, 102, D("0.50"), 3),
    ],
    "Playlist": [(1, None), (None, "lost")],
    "PlaylistTrack": [(1, 100), (1, 100), (None, 101)],
}


def frames(spark: SparkSession, **replaced: list[tuple]) -> dict[str, DataFrame]:
    rows = {**ROWS, **replaced}
    return {t: spark.createDataFrame(rows[t], SCHEMAS[t]) for t in SCHEMAS}
