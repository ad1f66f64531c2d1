"""A sample of our own with results derived by hand.

Order totals repeat on two to four lines.  K1 has two orders of its own, K3 has
none, K2 and K4 share a number, R13 lies across a month, R14 is on two numbers.
"""

from datetime import datetime

AS_OF = datetime(2024, 6, 10)

CUSTOMERS = [
    ("K1", "Mira Stone", "4700001", "Harbour"),
    ("K2", "Tomas Reed", "4700002", "Valley"),
    ("K3", "Ines Holt", "4700003", "Harbour"),
    ("K4", "Jun Park", "4700002", "Ridge"),
    ("K5", "Olga Brandt", "4700005", "Valley"),
]

# order: amount, and (mobile, time) of each line
ORDERS = {
    "R10": ("120.5", [("4700001", "2024-05-20T10:00:00")] * 2),
    "R11": ("80", [("4700001", "2024-06-02T08:30:00")] * 3),
    "R12": ("45.25", [("4700002", "2024-04-11T17:05:09")] * 4),
    "R13": ("300", [("4700005", "2024-05-31T23:50:00"), ("4700005", "2024-06-01T00:10:00")]),
    "R14": ("64", [("4700005", "2024-06-05T12:00:00"), ("4700001", "2024-06-05T12:05:00")]),
}

LINES = [
    (order, mobile, time, f"SKU-{number}", "1", amount)
    for order, (amount, lines) in ORDERS.items()
    for number, (mobile, time) in enumerate(lines)
]


def customers_csv(rows=CUSTOMERS, header="customer_id,customer_name,mobile_number,region") -> str:
    return "\n".join([header, *[",".join(row) for row in rows]]) + "\n"


def orders_xml(lines=LINES, amount="total_amount") -> str:
    tags = ["order_id", "mobile_number", "order_date_time", "sku_id", "sku_count", amount]
    orders = [
        "  <order>\n"
        + "".join(f"    <{t}>{v}</{t}>\n" for t, v in zip(tags, line) if v is not None)
        + "  </order>\n"
        for line in lines
    ]
    return "<orders>\n  <!-- a batch -->\n" + "".join(orders) + "  <!-- an <order> may follow -->\n</orders>\n"
