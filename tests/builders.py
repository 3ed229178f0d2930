"""Small tables for tests, in the columns of the schemas."""

from datetime import date
from decimal import Decimal

from pyspark.sql import functions as F

from remitlens import schemas
from remitlens.config import CandidateFilterCriteria, IntakePolicy, SkewPolicy
from remitlens.operators import candidates, intake, payer

DAY = date(2026, 7, 1)
FIELDS = [part.split()[0] for part in schemas.PAYMENT.replace("decimal(14,2)", "money").split(",") if part.strip()]


def money(value):
    return Decimal(str(value)).quantize(Decimal("0.01"))


def payments(spark, *rows):
    base = dict(company_id="c1", payment_id="p1", amount=100, currency="INR", payment_date=DAY, allocated_amount=0, status="UNRECONCILED", transaction_type="CREDIT")
    full = []
    for row in rows:
        r = {**base, **row}
        r["amount"], r["allocated_amount"] = money(r["amount"]), money(r["allocated_amount"])
        r["unallocated_amount"] = money(r["unallocated_amount"]) if "unallocated_amount" in r else r["amount"] - r["allocated_amount"]
        full.append(tuple(r.get(f) for f in FIELDS))
    return spark.createDataFrame(full, schemas.PAYMENT)


def customers(spark, *rows):
    """rows: dict(id, name, tax_id, aliases, identifiers, archived, company)."""
    c = [(r.get("company", "c1"), r["id"], r["name"], r.get("tax_id"), None, None, r.get("archived", False)) for r in rows]
    a = [(r.get("company", "c1"), r["id"], x) for r in rows for x in r.get("aliases", [])]
    i = [(r.get("company", "c1"), r["id"], t, v, True) for r in rows for t, v in r.get("identifiers", [])]
    return (spark.createDataFrame(c, schemas.CUSTOMER), spark.createDataFrame(a, schemas.CUSTOMER_ALIAS),
            spark.createDataFrame(i, schemas.CUSTOMER_IDENTIFIER))


def invoices(spark, *rows):
    base = dict(company_id="c1", customer_id="k1", issue_date=date(2026, 4, 1), due_date=date(2026, 5, 1), paid_amount=0, currency="INR", status="PENDING", is_archived=False)
    full = []
    for n, row in enumerate(rows):
        r = {"invoice_id": f"i{n:04d}", "invoice_number": f"INV-{n:04d}", **base, **row}
        total = money(r["total"])
        paid = money(r["paid_amount"])
        full.append((r["company_id"], r["invoice_id"], r["customer_id"], r["invoice_number"], r["issue_date"], r["due_date"], total, paid, total - paid,
                     r["currency"], r["status"], r["is_archived"]))
    return spark.createDataFrame(full, schemas.INVOICE)


def judged(df):
    return intake.evaluate_intake(df, IntakePolicy(today=date(2026, 12, 31)))


def identified(spark, pays, *people):
    c, a, i = customers(spark, *people)
    return payer.identify_payers(judged(pays), payer.customer_context(c, a, i))


def universe(pays, invs, criteria=CandidateFilterCriteria(), customer="k1", skew=SkewPolicy()):
    known = judged(pays).withColumns({"customer_id": F.lit(customer), "customer_is_archived": F.lit(False)})
    return candidates.filter_candidates(candidates.resolved_payments(known), invs, criteria, skew)
