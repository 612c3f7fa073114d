"""A hand-written shop: one row per branch of the rules."""

from __future__ import annotations

from decimal import Decimal

from tradewinds.sources.schemas import RAW_SCHEMAS

D = Decimal

ROWS = {
    # order, customer, status, purchase, approved, carrier, delivered, estimated
    "orders": [
        ("o1", "c1", " Delivered\r", "2017-01-01 23:50:00", "2017-01-02 00:10:00", "2017-01-03 00:00:00", "2017-01-10 12:00:00", "2017-01-15 00:00:00"),
        ("o2", "c2", "delivered", "2017-01-05 00:00:00", "", "", "", "2017-01-20 00:00:00"),
        ("o3", "c3", "canceled", "2017-02-01 00:00:00", "", "", "2017-02-05 00:00:00", "2017-02-20 00:00:00"),
        ("o4", "c3", "shipped", "2017-03-01 00:00:00", "2017-03-01 10:00:00", "n/a", "", ""),
        ("o5", "c1", "unavailable", "2017-03-02 00:00:00", "2017-03-01 23:59:59", "", "", ""),
        ("o6", "c2", "delivered", "2017-03-31 08:00:00", "2017-03-31 09:00:00", "2017-04-01 00:00:00", "2017-04-02 00:00:00", "later"),
        ("o7", "c5", "delivered", "2017-01-20 00:00:00", "2017-01-20 00:00:00", "2017-01-21 00:00:00", "2017-01-22 00:00:00", "2017-01-30 00:00:00"),
        ("o8", "c1", "delivered", "n/a", "", "", "2017-01-22 00:00:00", ""),
    ],
    # order, item, product, seller, limit, price, freight
    "order_items": [
        ("o1", "1", "p1", "s1", "2017-01-03 00:00:00\r", D("10.00"), D("2.50")),
        ("o1", "2", "p2", "s2", "2016-12-31 00:00:00", D("10.00"), None),
        ("o3", " x", "p1", "s1", "soon", D("1.00"), D("1.00")),
        ("o6", "1", "p3", "s9", "2017-04-03 00:00:00", D("100.00"), D("5.00")),
        ("o6", "2", "p3", "s1", "2017-04-03 00:00:00", D("50.00"), D("5.00")),
        ("o9", "1", "p1", "s1", "2017-04-03 00:00:00", D("9.00"), D("1.00")),
        ("o9", "1", None, "s1", "2017-04-03 00:00:00", D("9.00"), D("1.00")),
    ],
    "order_payments": [
        ("o1", 1, "Credit_Card ", 3, D("22.50")),
        ("o6", 1, "boleto", 0, D("0.00")),
        ("", 1, "voucher", 1, D("1.00")),
        ("o2", None, "voucher", 1, D("1.00")),
    ],
    "order_reviews": [
        ("r1", "o1", 5, " ", " Nice\r", "2016-12-31 00:00:00", "2017-01-12 00:00:00"),
        ("r2", "o6", 1, "Bad", None, "2017-04-05 00:00:00", ""),
        ("r3", "o6", None, "", "", "", ""),
        ("", "o6", 3, "", "", "", ""),
    ],
    # c1 and c5 are one person
    "customers": [
        ("c1", "u1", "01000", " Rio ", "rj\r"),
        ("c2", "u2", "02000", "Santos", "SP"),
        ("c3", "u3", "09000", "x", "SP"),
        ("c4", "u4", "01000", " ", "sp"),
        ("c5", "u1", "01000", "Rio", "RJ"),
        ("", "u9", "", "", ""),
    ],
    "products": [
        ("p1", " Brinquedos\r", 1, 2, 3, 4, 2000, 2000, 2000),
        ("p2", " ", 1, 2, 3, 0, None, 10, 10),
        ("p3", "livros", 1, 2, 3, None, 1, 1, 1),
        ("", "livros", 1, 2, 3, 4, 1, 1, 1),
    ],
    "sellers": [("s1", "01000", "Rio", "RJ"), ("s2", "09000", " ", "SP"), (" ", "", "", "")],
    "geolocation": [
        ("01000", D("-20"), D("-40"), "Rio", "RJ"),
        ("01000", D("-20"), D("-40"), "rio\r", "rj"),
        ("01000", D("-10"), D("-40"), "rio", "RJ"),
        ("01000\r", D("-10"), D("-40"), "niteroi", "RJ"),
        ("01000", D("40"), D("-40"), "niteroi", "RJ"),
        ("02000", D("40"), D("-40"), "santos", "SP"),
        ("03000", None, None, "x", "SP"),
        (" ", D("-20"), D("-40"), "x", "SP"),
    ],
    "category_translation": [("brinquedos", "Toys "), ("jogos", "games")],
}


def raw_shop(spark):
    return {name: spark.createDataFrame(rows, RAW_SCHEMAS[name]) for name, rows in ROWS.items()}
