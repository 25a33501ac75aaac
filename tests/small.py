"""Hand-built relations: a few rows that sit on the edges of the rules."""

from __future__ import annotations

from datetime import datetime, timedelta
from decimal import Decimal

from rentlens.sources import Relations

D = datetime

# film_id, title, allowed days, rate, category ids
FILMS = [
    (1, "One", 3, "2.99", [1]), (2, "Two", 3, "0.99", [1]), (3, "Three", 5, "4.99", [2]),
    (4, "Four", 7, "2.99", [2]), (5, "Five", 3, "0.99", [3]), (6, "Six", 4, "4.99", [1, 3]),
]
CATEGORIES = [(1, "Action"), (2, "Comedy"), (3, "Drama"), (4, "Empty")]

# rental_id, customer, film, rented, days out (None: not returned), payments
RENTALS = [
    # Customer 1: on the limit, over it by a second, not returned, twice paid.
    (101, 1, 1, D(2020, 1, 31, 10), timedelta(days=3), ["2.99"]),
    (102, 1, 2, D(2020, 2, 1, 9), timedelta(days=3, seconds=1), ["0.99", "1.00"]),
    (103, 1, 3, D(2020, 2, 1, 9), None, []),
    (104, 1, 1, D(2020, 3, 5, 23, 30), timedelta(days=9), ["2.99"]),
    # Customer 2: a single rental, paid with NULL.
    (201, 2, 5, D(2020, 3, 1, 12), timedelta(days=1), [None]),
    # Customer 3: all films of two categories; ties for the top genre.
    (301, 3, 3, D(2020, 1, 1), timedelta(days=2), ["4.99"]),
    (302, 3, 4, D(2020, 1, 1), timedelta(days=8), ["2.99"]),
    (303, 3, 1, D(2020, 2, 10, 8), timedelta(days=1), ["2.99"]),
    (304, 3, 2, D(2020, 2, 12, 7), timedelta(days=1), ["0.99"]),
    # Customer 4: the last rental of all; a film in two categories.
    (401, 4, 6, D(2020, 3, 31, 20), timedelta(days=2), ["4.99", "2.00"]),
    (402, 4, 5, D(2020, 3, 30, 20), timedelta(days=5), []),
    # Customer 5 has no address and must not appear.
    (501, 5, 1, D(2020, 5, 1), timedelta(days=1), ["2.99"]),
]
CUSTOMERS = [(1, "Ann"), (2, "Bob"), (3, "Cy"), (4, "Di"), (5, "Ed")]


def relations(spark, rentals=None, films=None) -> Relations:
    rentals, films = rentals or RENTALS, films or FILMS

    def frame(rows, schema):
        return spark.createDataFrame(rows, schema)

    return Relations(
        rental=frame(
            [(i, at, at + out if out is not None else None, c, f * 10) for i, c, f, at, out, _ in rentals],
            "rental_id long, rental_date timestamp_ntz, return_date timestamp_ntz, "
            "customer_id long, inventory_id long",
        ),
        payment=frame(
            [(r[0], Decimal(a) if a else None) for r in rentals for a in r[5]],
            "rental_id long, amount decimal(5,2)",
        ),
        customer=frame(
            [(i, name, "X", f"{name}@x", 1, i) for i, name in CUSTOMERS],
            "customer_id long, first_name string, last_name string, email string, "
            "active int, address_id long",
        ),
        address=frame([(i, 1 + i % 2) for i in range(1, 5)], "address_id long, city_id long"),
        city=frame([(1, "Oslo", 1), (2, "Rome", 2)], "city_id long, city string, country_id long"),
        country=frame([(1, "Norway"), (2, "Italy")], "country_id long, country string"),
        inventory=frame([(f[0] * 10, f[0]) for f in films], "inventory_id long, film_id long"),
        film=frame(
            [(i, t, "", 2006, days, Decimal(rate), 90, "PG", Decimal("9.99")) for i, t, days, rate, _ in films],
            "film_id long, title string, description string, release_year int, rental_duration int, "
            "rental_rate decimal(4,2), length int, rating string, replacement_cost decimal(5,2)",
        ),
        film_category=frame(
            [(f[0], c) for f in films for c in f[4]], "film_id long, category_id long"
        ),
        category=frame(CATEGORIES, "category_id long, name string"),
    )


def fact_rows(rentals=None, films=None) -> list[dict]:
    """The joined row set, row by row."""
    names = dict(CATEGORIES)
    terms = {f[0]: f for f in films or FILMS}
    rows = []
    for i, customer, film, at, out, amounts in rentals or RENTALS:
        if customer == 5:
            continue
        for category in sorted(names[c] for c in terms[film][4]):
            for amount in amounts or [None]:
                allowed = timedelta(days=terms[film][2])
                rows.append(
                    {
                        "customer": customer, "rental": i, "at": at, "category": category,
                        "film": film, "amount": float(amount) if amount else None,
                        "late": None if out is None else out > allowed,
                        "overdue": max((out - allowed) / timedelta(days=1), 0) if out else 0.0,
                    }
                )
    return sorted(rows, key=lambda r: (r["customer"], r["at"], r["rental"], r["category"]))
