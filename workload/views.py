"""Receivables tables derived from the test tables, in SQL both engines run unchanged.

``orders`` become invoices and payments, ``customer`` becomes the customer directory, ``events``
become bank statements, and orders are also written out as invoice documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
        "embeddings", "pages", "benchmark", "labels", "conversations"]

DIRECTORY = """
select c_custkey customer_id, c_nationkey company_id,
       case c_custkey % 4 when 0 then tok || ' ' || seg || ' Pvt Ltd'
                          when 1 then upper(tok) || ' & ' || seg || ' LLP'
                          when 2 then 'Société ' || tok || ' S.A'
                          else tok || ' industries' end name,
       case c_custkey % 11 when 0 then 'PENDING' when 1 then null
                           else 'TX' || lpad(cast(c_custkey as string), 8, '0') end tax_id,
       tok || '@example.com' email, '+91' || lpad(cast(c_custkey as string), 10, '7') phone,
       c_custkey % 41 = 0 is_archived, tok, seg, cast(900000000 + c_custkey as string) account,
       lead(c_custkey) over (partition by c_nationkey order by c_custkey) next_id
from (select *, translate(lpad(cast(c_custkey as string), 6, '0'), '0123456789', 'bdfgklmnpr') tok,
             lower(c_mktsegment) seg from {customer})
"""

CUSTOMERS = "select customer_id, company_id, name, tax_id, email, phone, is_archived from {directory}"

ALIASES = """
select company_id, customer_id, upper(tok) || ' Trading' alias_name from {directory} where customer_id % 3 = 0
union all
select company_id, customer_id, tok || '-Exports' alias_name from {directory} where customer_id % 6 = 0
"""

IDENTIFIERS = """
select company_id, customer_id, 'BANK_ACCOUNT' identifier_type, account identifier_value,
       customer_id % 29 <> 0 is_active from {directory} where customer_id % 4 <> 3
union all
select company_id, customer_id, 'UPI_VPA' identifier_type, tok || '@okbank' identifier_value,
       true is_active from {directory} where customer_id % 5 = 0
union all
select company_id, customer_id, 'VIRTUAL_ACCOUNT' identifier_type,
       'VA-' || lpad(cast(customer_id as string), 8, '0') identifier_value,
       true is_active from {directory} where customer_id % 7 = 0
"""

_INVOICES = """
select o_orderkey invoice_id, c_nationkey company_id, o_custkey customer_id,
       'INV-' || lpad(cast(o_orderkey as string), 8, '0') invoice_number,
       issue issue_date, issue + 30 due_date,
       total total_amount, paid paid_amount, cast(total - paid as decimal(14,2)) outstanding_amount,
       case when o_orderkey % 10 = 9 then 'USD' else 'INR' end currency,
       case o_orderstatus when 'O' then 'PENDING' when 'P' then 'PARTIALLY_PAID' else 'PAID' end status,
       o_orderkey % 37 = 0 is_archived
from (select *, case o_orderstatus when 'O' then cast(0 as decimal(14,2))
                                   when 'P' then cast(total * 0.25 as decimal(14,2)) else total end paid
      from (select o.*, c_nationkey, cast(@total@ as decimal(14,2)) total,
                   cast(o_orderdate as date) issue
            from {orders} o join {customer} on o_custkey = c_custkey))
"""

INVOICES = _INVOICES.replace("@total@", "o_totalprice")
# totals rounded up to 50,000, so that several candidates and sets fit one payment
ROUND_INVOICES = _INVOICES.replace("@total@", "ceil(o_totalprice / 50000.0) * 50000")

RECEIPTS = """
select invoice_id payment_id, company_id, customer_id, invoice_number, issue_date, due_date,
       cast(case invoice_id % 7 when 0 then outstanding_amount
                           when 1 then cast(outstanding_amount * 0.5 as decimal(14,2))
                           when 2 then outstanding_amount + coalesce(l1, 0)
                           when 3 then outstanding_amount + coalesce(l1, 0) + coalesce(l2, 0)
                           when 4 then outstanding_amount + 0.01 end as decimal(14,2)) amount
from (select *, lag(outstanding_amount, 1) over (partition by customer_id order by issue_date, invoice_id) l1,
             lag(outstanding_amount, 2) over (partition by customer_id order by issue_date, invoice_id) l2
      from {invoices} where status <> 'PAID' and not is_archived and currency = 'INR')
where invoice_id % 7 < 5
"""

PAYMENTS = """
select payment_id, r.company_id, amount,
       case when payment_id % 43 = 0 then ' inr ' when payment_id % 47 = 0 then 'IN1' else 'INR' end currency,
       case when payment_id % 59 = 0 then date '2999-01-01'
            else due_date + cast(payment_id % 45 as int) - 10 end payment_date,
       case payment_id % 12 when 4 then upper(d.tok) || ' TRADING' when 5 then d.tok || ' ' || d.seg || ' Private Limited'
                            when 6 then d.name when 9 then n.name end payer_raw_name,
       case payment_id % 12 when 0 then substr(d.account, 1, 3) || ' ' || substr(d.account, 4, 3) || '-' || substr(d.account, 7, 3)
                            when 9 then d.account when 10 then d.account end payer_raw_identifier,
       case when payment_id % 12 = 7 then lower(substr(d.tax_id, 1, 2)) || '-' || substr(d.tax_id, 3, 8)
            when payment_id % 12 = 11 then 'UTR' || lpad(cast(payment_id as string), 12, '0')
            when payment_id % 5 = 0 then invoice_number end payment_reference,
       case payment_id % 12 when 1 then d.account when 10 then n.account end bank_account_number,
       case when payment_id % 12 = 2 then 'UPI-' || lpad(cast(payment_id as string), 8, '0') || '-' || d.tok || '@okbank'
            when payment_id % 12 = 3 then 'IMPS ' || d.account || ' received'
            when payment_id % 12 = 8 then 'TRANSFER FROM ' || d.tok || ' ' || d.seg
            when payment_id % 12 = 11 then null
            when payment_id % 2 = 0 then 'NEFT ' || invoice_number || ' PAYMENT'
            when payment_id % 3 = 0 then 'BILL' || substr(invoice_number, 4, 9) || ' NEFT000123456789'
            else 'UPI TRANSFER' end narration,
       cast(case when payment_id % 17 = 0 then cast(amount * 0.25 as decimal(14,2))
                 when payment_id % 23 = 0 then amount else 0 end as decimal(14,2)) allocated_amount,
       cast(case when payment_id % 17 = 0 then amount - cast(amount * 0.25 as decimal(14,2))
                 when payment_id % 23 = 0 then 0 when payment_id % 53 = 0 then amount + 1 else amount end as decimal(14,2)) unallocated_amount,
       case when payment_id % 17 = 0 then 'PARTIALLY_RECONCILED' when payment_id % 23 = 0 then 'RECONCILED'
            when payment_id % 19 = 0 then 'IGNORED' else 'UNRECONCILED' end status,
       case when payment_id % 31 = 0 then 'DEBIT' else 'CREDIT' end transaction_type,
       r.customer_id true_customer_id
from {receipts} r join {directory} d on r.customer_id = d.customer_id
     left join {directory} n on d.next_id = n.customer_id
"""

# payments whose customer is known: the input of the candidate operators on their own
KNOWN = """
select payment_id, company_id, customer_id, amount effective_amount, 'INR' currency,
       due_date + cast(payment_id % 45 as int) - 10 payment_date,
       case when payment_id % 2 = 0 then 'NEFT ' || invoice_number || ' PAYMENT' else 'UPI TRANSFER' end narration
from {receipts}
"""

SQL = {
    "directory": DIRECTORY, "customers": CUSTOMERS, "aliases": ALIASES, "identifiers": IDENTIFIERS,
    "invoices": INVOICES, "receipts": RECEIPTS, "payments": PAYMENTS, "known": KNOWN,
}
ROUND_SQL = {**SQL, "invoices": ROUND_INVOICES}
ORDER = list(SQL)


class Tables:
    """The views as DataFrames, built on first use."""

    def __init__(self, spark: SparkSession, sf_dir: str, sql: dict[str, str] = SQL) -> None:
        self.spark, self.sf_dir, self.sql, self._made = spark, sf_dir, sql, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._made:
            if name in BASE:
                self._made[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            else:
                text = self.sql[name]
                used = {n: getattr(self, n) for n in [*BASE, *ORDER] if "{" + n + "}" in text}
                self._made[name] = self.spark.sql(text, **used)
        return self._made[name]


def ctes(*names: str, sql: dict[str, str] = SQL) -> str:
    """``with ...`` clause that defines the views (and what they need) for DuckDB."""
    needed: list[str] = []

    def visit(name: str) -> None:
        for other in ORDER:
            if "{" + other + "}" in sql[name] and other not in needed:
                visit(other)
        if name not in needed:
            needed.append(name)

    for name in names:
        visit(name)
    named = {n: n for n in [*BASE, *ORDER]}
    return "with " + ",\n".join(f"{n} as ({sql[n].format(**named)})" for n in needed)


# --- bank statement files: 500 events each, four layouts ---------------------------------------

STATEMENT_EVENTS = """
select event_id, cast(floor(event_id / 500) as bigint) file_id, cast(floor(event_id / 500) % 7 as int) company_id,
       cast(floor(event_id / 500) % 4 as int) layout, cast(ts as date) as day, cast(value as decimal(14,2)) amount,
       event_id % 3 <> 0 is_credit,
       case when event_id % 89 = 0 then '' when event_id % 71 = 0 then '=HYPERLINK ' || event_type
            when event_id % 11 = 0 then 'NEFT/HDFC' || lpad(cast(event_id as string), 10, '0') || '/' || event_type
            else event_type || ', "user" ' || cast(user_id as string) end narration,
       case when event_id % 10 in (0, 1) then 'EV' || lpad(cast(event_id - event_id % 2 as string), 8, '0')
            when event_id % 250 = 7 then 'SHARED' || cast(user_id % 3 as string)
            when event_id % 4 = 2 then 'N/A' else '' end reference,
       event_id % 97 = 0 bad_date, event_id % 83 = 0 bad_amount
from {events}
"""

SQL["statement_events"] = STATEMENT_EVENTS
ORDER.append("statement_events")
ROUND_SQL["statement_events"] = STATEMENT_EVENTS

STATEMENT_LINES = """
select event_id, file_id, company_id, layout,
       case layout
         when 0 then d || ',"' || q || '",' || reference || ',' || case when is_credit then a else '' end || ',' || case when is_credit then '' else a end
         when 1 then d || ';"' || q || '";' || reference || ';' || a || ';' || case when is_credit then 'Cr' else 'DR' end
         when 2 then d || '\t"' || q || '"\t' || reference || '\t' || case when is_credit then '' else '-' end || a
         else d || '|"' || q || '"|' || reference || '|' || case when is_credit then '' else a end || '|' || case when is_credit then a else '' end
       end line
from (select *, replace(narration, '"', '""') q, case when bad_amount then 'abc' else cast(amount as string) end a,
             case when bad_date then 'soon' when layout = 0 then iso
                  when layout = 1 then substr(iso, 9, 2) || '-' || substr(iso, 6, 2) || '-' || substr(iso, 1, 4)
                  when layout = 2 then replace(iso, '-', '/')
                  else substr(iso, 9, 2) || '.' || substr(iso, 6, 2) || '.' || substr(iso, 1, 4) end d
      from (select *, cast(day as string) iso from {statement_events}))
"""

STATEMENT_HEADERS = {
    0: "Txn Date,Narration,Chq/Ref No,Deposit,Withdrawal",
    1: "Date;Description;Ref No;Amount;Type",
    2: "Account 12345\nPrinted for you\nDate\tParticulars\tReference\tAmount",
    3: "Date|Remarks|UTR|Debit|Credit",
}

# --- invoice documents written from invoices ----------------------------------------------------

# what each document says, as columns
DOCUMENT_FACTS = """
select i.invoice_id, i.company_id, i.invoice_number, d.name, i.issue_date, i.due_date, i.total_amount,
       cast(i.total_amount * 0.8 as decimal(14,2)) subtotal,
       cast(i.total_amount - cast(i.total_amount * 0.8 as decimal(14,2)) + case when i.invoice_id % 6 = 5 then 7 else 0 end as decimal(14,2)) tax,
       case when i.invoice_id % 5 <> 0 then '27ABCDE' || lpad(cast(i.customer_id % 10000 as string), 4, '0') || 'F1Z5' end gstin,
       'PO-' || lpad(cast(i.invoice_id % 1000 as string), 5, '0') po,
       i.invoice_id % 7 = 3 no_number, i.invoice_id % 9 = 4 slashed, i.invoice_id % 10 = 6 total_last, i.invoice_id % 8 = 2 no_due,
       i.currency
from {invoices} i join {directory} d on i.customer_id = d.customer_id
"""
SQL["document_facts"] = DOCUMENT_FACTS
ORDER.append("document_facts")
ROUND_SQL["document_facts"] = DOCUMENT_FACTS

DOCUMENT_TEXTS = """
select invoice_id, company_id,
       'Statement of supply\n' || case when no_number then '' else 'Invoice No: ' || invoice_number || '\n' end
       || 'Bill To: ' || name || '\n' || case when gstin is null then '' else 'GSTIN ' || gstin || '\n' end || 'PO No: ' || po || '\n'
       || 'Dated ' || issue_text || '\n' || case when no_due then '' else 'Payable by ' || due_text || '\n' end
       || case when total_last then '' else total_text end || 'Sub Total: ' || cast(subtotal as string) || '\n'
       || 'Tax Amount: ' || cast(tax as string) || '\n' || case when total_last then total_text else '' end text
from (select *, case when slashed then substr(i, 9, 2) || '/' || substr(i, 6, 2) || '/' || substr(i, 1, 4) else i end issue_text,
             case when slashed then substr(u, 9, 2) || '/' || substr(u, 6, 2) || '/' || substr(u, 1, 4) else u end due_text,
             'Grand Total: ' || currency || ' ' || cast(total_amount as string) || '\n' total_text
      from (select *, cast(issue_date as string) i, cast(due_date as string) u from {document_facts}))
"""
