"""SQL counterparts of the registered queries, for DuckDB.

They follow the rules directly (pairs of everything within a company, plain joins for sets of up to
four) and share nothing with the Spark code but the view definitions.
"""

from __future__ import annotations

from remitlens import vocab
from workload.views import ROUND_SQL, SQL, ctes


def _list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


STOP = _list(vocab.BANKING_STOPWORDS)


def clean(x: str) -> str:
    return f"trim(regexp_replace(lower(replace(replace(strip_accents(coalesce({x}, '')), '&', ' and '), '@', ' at ')), '[^a-z0-9]+', ' ', 'g'))"


def legal(cleaned: str) -> str:
    return f"regexp_replace({cleaned}, '^(.+?) (?:{'|'.join(vocab.LEGAL_SUFFIXES)})$', '\\1')"


def words(cleaned: str) -> str:
    return (f"list_distinct(list_filter(string_split({cleaned}, ' '), lambda w: length(w) >= 3 and not regexp_full_match(w, '[0-9]+') "
            f"and not list_contains({STOP}, w)))")


def ident(x: str) -> str:
    s = f"trim(coalesce({x}, ''))"
    keep = "'[^a-zA-Z0-9.\\-_]', '', 'g'"
    return (f"case when contains({s}, '@') then lower(regexp_replace(split_part({s}, '@', 1), {keep})) || '@' || "
            f"lower(regexp_replace(regexp_replace({s}, '^[^@]*@', ''), {keep})) else lower(regexp_replace({s}, '[\\s\\-_/.]', '', 'g')) end")


RAIL = "'^(?:upi|neft|imps|rtgs|cr|dr|clg|ift|tfr|trf)[-_/]+(?:[0-9]+[-_/]+)?'"


def vpas(x: str) -> str:
    user, handle = "split_part(lower(m), '@', 1)", "split_part(lower(m), '@', 2)"
    cut = f"regexp_replace({user}, {RAIL}, '')"
    return (f"list_filter(flatten(list_transform(regexp_extract_all(coalesce({x}, ''), '\\b[a-zA-Z0-9.\\-_]{{2,64}}@[a-zA-Z0-9.\\-_]{{2,32}}\\b'), "
            f"lambda m: [case when {cut} <> '' and not list_contains({STOP}, {cut}) then {cut} || '@' || {handle} end, "
            f"case when {cut} <> {user} and not list_contains({STOP}, {user}) then lower(m) end])), lambda v: v is not null)")


def accounts(x: str) -> str:
    return f"regexp_extract_all(coalesce({x}, ''), '\\b[0-9]{{9,18}}\\b')"


def token_norm(x: str) -> str:
    return f"upper(trim(regexp_replace(regexp_replace(trim({x}), '^(INV|BILL|INVOICE)[-_/:]?', '', 'i'), '[-_/:]', '', 'g')))"


def alnum(x: str) -> str:
    return f"upper(regexp_replace(coalesce({x}, ''), '[^A-Za-z0-9]', '', 'g'))"


# --- text -----------------------------------------------------------------------------------------

CLEAN_TEXT = f"select doc_id, sha256({clean('text')}) cleaned, length({clean('text')}) length from documents"
LEGAL_NAME = f"{ctes('customers')} select customer_id, {legal(clean('name'))} legal_name from customers"
NAME_TOKENS = f"""select doc_id, cast(len(w) as bigint) tokens, sha256(array_to_string(list_sort(w), ' ')) digest
from (select doc_id, {words('c')} w from (select doc_id, {clean('text')} c from documents))"""
NORMALIZED_IDENTIFIERS = f"{ctes('identifiers')} select customer_id, identifier_type, {ident('identifier_value')} identifier from identifiers"
VPAS = f"{ctes('payments')} select * from (select payment_id, array_to_string({vpas('narration')}, ' ') vpas from payments) where vpas <> ''"
ACCOUNTS = f"select * from (select doc_id, array_to_string({accounts('text')}, ' ') accounts from documents) where accounts <> ''"

_UTR = ["\\b([A-Z]{4}[0-9]{10,16})\\b", "(?i)\\b(?:UPI|IMPS|NEFT|RTGS)[/:_-]([A-Z0-9]{10,22})\\b", "(?i)\\bUTR[:\\s-]*([A-Z0-9]{10,22})\\b", "(?i)\\bREF[:\\s-]*([A-Z0-9]{8,22})\\b"]


def utr(x: str) -> str:
    return "coalesce(" + ", ".join(f"nullif(regexp_extract({x}, '{p}', 1), '')" for p in _UTR) + ")"


def guarded(x: str) -> str:
    return f"case when regexp_matches(trim({x}), '^[=+\\-@\\t\\r]') then '''' || trim({x}) else trim({x}) end"


def valid_reference(x: str) -> str:
    plain = f"upper(regexp_replace(coalesce({x}, ''), '[^A-Za-z0-9]', '', 'g'))"
    return f"(length({plain}) >= 4 and {plain} not in ('NONE', 'NULL', 'NOTAVAILABLE'))"


UTR = f"{ctes('statement_events')} select event_id, {utr('narration')} reference from statement_events"
EVIDENCE_TOKENS = f"""{ctes('payments')} select payment_id,
array_to_string(regexp_extract_all(coalesce(narration, ''), '(?i)\\b(?:INV|BILL|REC)[-_A-Z0-9]{{3,30}}\\b'), ',') invoice_tokens,
nullif(regexp_extract(coalesce(narration, ''), '(?i)\\b[A-Z0-9]{{12,22}}\\b'), '') utr from payments"""
INVOICE_TOKENS = f"{ctes('invoices')} select invoice_id, {token_norm('invoice_number')} token from invoices"
FORMULA_GUARD = f"{ctes('statement_events')} select event_id, {guarded('narration')} narration from statement_events"
REFERENCE_VALIDITY = f"{ctes('statement_events')} select event_id, {valid_reference('reference')} is_valid from statement_events"


def fingerprint(company: str, ref: str, day: str, amount: str, direction: str, narration: str) -> str:
    return (f"sha256(case when {valid_reference(ref)} then 'REF|' || {company} || '|SHARED|' || upper(regexp_replace({ref}, '\\s+', '', 'g')) "
            f"else 'FALLBACK|' || {company} || '|UNKNOWN|' || cast({day} as varchar) || '|' || cast({amount} as varchar) || '|INR|' || {direction} || '|NOBAL|' || "
            f"regexp_replace(lower(trim({narration})), '\\s+', ' ', 'g') end)")


FINGERPRINTS = f"""{ctes('statement_events')} select event_id, {fingerprint('company_id', 'reference', 'day', 'amount', "case when is_credit then 'CREDIT' else 'DEBIT' end", 'narration')} fingerprint
from statement_events"""
FILE_HASH = "select doc_id, sha256(text) file_hash from documents"
MONEY = f"""{ctes('invoices')} select invoice_id, case when currency = 'INR' then cast(total_amount + paid_amount as decimal(14,2)) end added,
case when currency = 'INR' then cast(total_amount - paid_amount as decimal(14,2)) end subtracted, cast(total_amount * 0.125 as decimal(14,2)) multiplied,
case when currency <> 'INR' then null when total_amount < paid_amount then -1 when total_amount > paid_amount then 1 else 0 end::bigint compared,
case when currency = 'INR' then '₹' else currency || ' ' end || format('{{:,.2f}}', cast(total_amount as double)) formatted from invoices"""
STATEMENT_AMOUNTS = f"""{ctes('invoices')} select invoice_id, cast(case invoice_id % 4 when 0 then total_amount when 1 then -total_amount when 2 then total_amount + 0.01 end as decimal(14,2)) amount from invoices"""
STATEMENT_DATES = f"{ctes('invoices')} select invoice_id, case when invoice_id % 5 < 4 then issue_date end as day from invoices"
DOCUMENT_AMOUNTS = f"""{ctes('invoices')} select invoice_id, case when invoice_id % 4 < 2 then total_amount end amount,
case when invoice_id % 4 = 1 then 'USD' else 'INR' end currency, invoice_id % 4 < 2 is_valid from invoices"""
DOCUMENT_DATES = f"""{ctes('invoices')} select invoice_id, issue_date as day, invoice_id % 4 = 2 and extract(day from issue_date) <= 12 is_ambiguous from invoices"""
DATE_GAPS = f"""{ctes('known')} select k.payment_id, k.payment_date - r.due_date gap, abs(k.payment_date - r.due_date) distance, greatest(0, k.payment_date - r.due_date) overdue,
r.due_date + 30 window_end from known k join receipts r on k.payment_id = r.payment_id"""
TEMPORAL = f"""{ctes('invoices')} select invoice_id, invoice_id % 5 <> 0 is_valid, case invoice_id % 5 when 0 then 'DUE_BEFORE_ISSUE' when 1 then 'DUE_DATE_ABSENT' end warning from invoices"""
CURRENCY = f"{ctes('payments')} select payment_id, upper(trim(currency)) code, regexp_full_match(upper(trim(currency)), '[A-Z]{{3}}') is_code from payments"
TOTALS_CHECK = f"""{ctes('document_facts')}, x as (select invoice_id, total_amount, invoice_id % 4 = 1 skipped,
cast(subtotal + tax + case when invoice_id % 3 = 0 then 0.5 else 0 end as decimal(14,2)) expected, case when invoice_id % 3 = 0 then 1 else 0.05 end allowed from document_facts)
select invoice_id, skipped or abs(expected - total_amount) <= allowed is_valid, case when skipped then total_amount else expected end calculated_total,
cast(case when skipped then 0 else abs(expected - total_amount) end as decimal(14,2)) discrepancy from x"""
STORAGE_KEYS = """with b as (select page_id, regexp_replace(regexp_replace(regexp_replace(url, '^.*[/\\\\]', ''), '[^a-zA-Z0-9._-]', '_', 'g'), '^\\.+', '') safe from pages),
s as (select page_id, case when safe = '' then 'invoice_document.pdf' else safe end safe from b)
select page_id, 'h_' || left(regexp_replace(safe, '\\.[^.]*$', ''), 64) || case when contains(safe, '.') then '.' || left(regexp_extract(safe, '([^.]*)$', 1), 10) else '.pdf' end storage_key,
'h_' || regexp_replace(safe, '\\.[^.]*$', '') || case when contains(safe, '.') then '.' || regexp_extract(safe, '([^.]*)$', 1) else '.pdf' end whole_key from s"""


def mask_account(x: str) -> str:
    return f"case when length({x}) <= 4 then '****' else repeat('*', length({x}) - 4) || right({x}, 4) end"


def mask_vpa(x: str) -> str:
    return (f"case when contains({x}, '@') then case when length(split_part({x}, '@', 1)) <= 2 then '**' else left({x}, 2) || repeat('*', length(split_part({x}, '@', 1)) - 2) end "
            f"|| '@' || split_part({x}, '@', 2) else {mask_account(x)} end")


MASKS = f"""{ctes('identifiers')} select customer_id, identifier_type, {mask_account('identifier_value')} account, '••••••••' || right(identifier_value, 4) bullets,
{mask_vpa('identifier_value')} vpa, case when identifier_type = 'UPI_VPA' then {mask_vpa('identifier_value')} else {mask_account('identifier_value')} end evidence from identifiers"""

# --- statement files ------------------------------------------------------------------------------

_ROWS = f"""{ctes('statement_events')}, parsed as (
select *, lpad(cast(file_id as varchar), 8, '0') || '.csv' file_name,
  row_number() over (partition by file_id order by event_id) + case when layout = 2 then 3 else 1 end row_number,
  case when bad_date then 'transaction_date' when narration = '' then 'narration' when bad_amount then 'amount' end error_field,
  {guarded('narration')} safe, case when is_credit then 'CREDIT' else 'DEBIT' end direction from statement_events),
rows_ as (select *, coalesce(nullif(reference, ''), {utr('safe')}) ref from parsed),
printed as (select *, {fingerprint('company_id', 'ref', 'day', 'amount', 'direction', 'safe')} fp from rows_),
good as (select *, first_value(file_name) over (partition by company_id, fp order by file_name, row_number) first_file,
  row_number() over (partition by company_id, fp order by file_name, row_number) nth from printed where error_field is null),
judged as (select company_id, file_name, row_number, direction, day, amount, ref, fp, error_field,
  case when nth = 1 then 'IMPORTED' when first_file = file_name then 'DUPLICATE_IN_FILE' else 'DUPLICATE_STORED' end outcome from good
  union all select company_id, file_name, row_number, direction, day, amount, ref, fp, error_field, 'INVALID' from printed where error_field is not null)"""

STATEMENT_LAYOUTS = f"""{ctes('statement_events')} select distinct lpad(cast(file_id as varchar), 8, '0') || '.csv' file_name, case when layout = 2 then 2 else 0 end::bigint header_index,
case layout when 0 then ',' when 1 then ';' when 2 then chr(9) else '|' end delimiter,
case layout when 0 then 'Txn Date~Narration~Chq/Ref No~Deposit~Withdrawal' when 1 then 'Date~Description~Ref No~Amount~Type' when 2 then 'Date~Particulars~Reference~Amount'
  else 'Date~Remarks~UTR~Debit~Credit' end headers, 2::bigint narration_at, case layout when 0 then 4 when 3 then 5 else 0 end::bigint credit_at,
case layout when 1 then 4 when 2 then 4 else 0 end::bigint amount_at, cast(null as varchar) file_error from statement_events"""
STATEMENT_ROWS = f"""{_ROWS} select file_name, row_number, case when error_field is null then day end transaction_date, case when error_field is null then amount end amount,
case when error_field is null then direction end transaction_type, case when error_field is null then safe end narration, case when error_field is null then ref end reference_number, error_field from rows_"""
STATEMENT_OUTCOMES = f"{_ROWS} select company_id, outcome, count(*) as rows, cast(sum(row_number) as bigint) row_numbers from judged group by 1, 2"
STATEMENT_REPORT = f"""{_ROWS} select company_id, file_name, 'COMPLETED' status, count(*) total_rows, count(*) filter (outcome = 'IMPORTED' and direction = 'CREDIT') imported_payments,
count(*) filter (outcome = 'IMPORTED' and direction = 'DEBIT') skipped_debits, count(*) filter (outcome like 'DUPLICATE%') skipped_duplicates,
count(*) filter (outcome in ('INVALID', 'DUPLICATE_IN_FILE')) failed_rows from judged group by 1, 2"""


def stable(*parts: str) -> str:
    h = f"sha256({' || chr(124) || '.join(parts)})"
    return f"substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-' || substr({h}, 13, 4) || '-' || substr({h}, 17, 4) || '-' || substr({h}, 21, 12)"


STATEMENT_PAYMENTS = f"""{_ROWS} select {stable("'PAY'", 'cast(company_id as varchar)', 'fp')} payment_id, company_id, day payment_date, amount, amount unallocated_amount, ref payment_reference,
'UNRECONCILED' status, 'BANK_STATEMENT_CSV' source from judged where outcome = 'IMPORTED' and direction = 'CREDIT'"""
_LATER = f"""{_ROWS}, earlier as (select distinct company_id, fp from printed where error_field is null and file_name < '00000010.csv'),
later as (select p.*, e.fp is not null known, row_number() over (partition by p.company_id, p.fp order by file_name, row_number) nth,
  first_value(file_name) over (partition by p.company_id, p.fp order by file_name, row_number) first_file
  from printed p left join earlier e on p.company_id = e.company_id and p.fp = e.fp where error_field is null and file_name >= '00000010.csv')"""
STORED_DUPLICATES = f"""{_LATER}
select company_id, outcome, count(*) as rows from (select company_id, case when known then 'DUPLICATE_STORED' when nth = 1 then 'IMPORTED' when first_file = file_name then 'DUPLICATE_IN_FILE'
  else 'DUPLICATE_STORED' end outcome from later union all select company_id, 'INVALID' from printed where error_field is not null and file_name >= '00000010.csv') group by 1, 2"""
STORED_ROWS = f"""{_LATER}
select company_id, file_name, row_number, case when known then 'DUPLICATE_STORED' when nth = 1 then 'IMPORTED' when first_file = file_name then 'DUPLICATE_IN_FILE' else 'DUPLICATE_STORED' end outcome from later
union all select company_id, file_name, row_number, 'INVALID' from printed where error_field is not null and file_name >= '00000010.csv'"""
# a file that comes twice goes on under its first name
FILE_GATES = f"""{ctes('statement_events')} select company_id, lpad(cast(file_id as varchar), 8, '0') || '.csv' file_name, case when file_id % 7 in (1, 2) then 'FAILED' else 'COMPLETED' end status,
file_id % 7 in (1, 2) has_error, case when file_id % 7 in (1, 2) then 0 else count(*) end total_rows from statement_events where file_id % 7 <> 3 group by company_id, file_id"""
STATEMENT_OUTCOME_ROWS = f"{_ROWS} select company_id, file_name, row_number, outcome from judged"
STATEMENT_ERROR_ROWS = f"""{_ROWS} select company_id, file_name, row_number, case when outcome = 'DUPLICATE_IN_FILE' then 'reference_number' else error_field end field
from judged where outcome in ('INVALID', 'DUPLICATE_IN_FILE')"""
STATEMENT_ERRORS = f"""{_ROWS} select company_id, case when outcome = 'DUPLICATE_IN_FILE' then 'reference_number' else error_field end field, count(*) errors
from judged where outcome in ('INVALID', 'DUPLICATE_IN_FILE') group by 1, 2"""

# --- invoice files and customer search --------------------------------------------------------------

_SEARCH = """, texts as (select company_id, customer_id, lower(name) t from customers where not is_archived union all select company_id, customer_id, lower(tax_id) from customers where not is_archived
  union all select company_id, customer_id, lower(email) from customers where not is_archived union all select company_id, customer_id, lower(phone) from customers where not is_archived
  union all select a.company_id, a.customer_id, lower(alias_name) from aliases a join customers c on a.customer_id = c.customer_id where not c.is_archived
  union all select a.company_id, a.customer_id, lower(identifier_value) from identifiers a join customers c on a.customer_id = c.customer_id where not c.is_archived)"""
UNIQUE_SEARCH = f"""{ctes('directory', 'customers', 'aliases', 'identifiers')}{_SEARCH},
asked as (select distinct company_id, case when customer_id % 2 = 0 then tok else seg end query from directory)
select a.company_id, a.query, min(t.customer_id) customer_id from asked a join texts t on a.company_id = t.company_id and contains(t.t, lower(a.query)) group by 1, 2
having count(distinct t.customer_id) = 1"""
INVOICE_FILES = f"""{ctes('document_facts', 'customers', 'aliases', 'identifiers')}{_SEARCH},
lines as (select f.company_id, f.invoice_id, c.customer_id cid, c.tax_id, f.name, c.is_archived, f.issue_date, f.due_date, f.total_amount, f.invoice_id // 500 file_id,
  case when f.invoice_id % 50 = 7 then '' when f.invoice_id % 20 = 3 then 'inv-dup-' || cast(f.invoice_id // 100 as varchar) else f.invoice_number end num
  from document_facts f join customers c on f.name = c.name),
numbered as (select *, row_number() over (partition by company_id, file_id order by invoice_id) + 1 row_number from lines),
queries as (select distinct company_id, tax_id q from customers where tax_id is not null),
hits as (select q.company_id, q.q, min(t.customer_id) hit from queries q join texts t on q.company_id = t.company_id and contains(t.t, lower(q.q)) group by 1, 2 having count(distinct t.customer_id) = 1),
resolved as (select n.*, case n.invoice_id % 3 when 0 then n.cid when 1 then n.cid else h.hit end customer_id from numbered n left join hits h on n.company_id = h.company_id and n.tax_id = h.q),
own as (select r.*, case when exists (select 1 from invoices i where i.invoice_id % 13 = 5 and i.company_id = r.company_id and lower(i.invoice_number) = lower(r.num)) then 'ALREADY_STORED'
  when customer_id is null then 'CUSTOMER_NOT_FOUND' when invoice_id % 3 <> 2 and is_archived then 'CUSTOMER_ARCHIVED' when invoice_id % 40 = 9 then 'INVALID_ISSUE_DATE'
  when invoice_id % 60 = 11 then 'DUE_BEFORE_ISSUE' when invoice_id % 45 = 2 then 'INVALID_TOTAL_AMOUNT' end own from resolved r),
firsts as (select company_id, file_id, lower(num) k, min(row_number) f from own where own is null and num <> '' group by 1, 2, 3)
select o.company_id, lpad(cast(o.file_id as varchar), 8, '0') file_name, o.row_number, num invoice_number,
case when num = '' then 'MISSING_NUMBER' when f.f < o.row_number then 'DUPLICATE_IN_FILE' else own end error,
case when num <> '' and not coalesce(f.f < o.row_number, false) and own is null then customer_id end customer_id,
case when num <> '' and not coalesce(f.f < o.row_number, false) and own is null then total_amount end total
from own o left join firsts f on o.company_id = f.company_id and o.file_id = f.file_id and lower(o.num) = f.k"""

# --- documents ------------------------------------------------------------------------------------

# the first "total" in the text counts, so a total printed last loses to the subtotal
_DOCS = f"""{ctes('document_facts')}, read as (select *, case when no_number then null else invoice_number end num,
  case when total_last then subtotal else total_amount end got, case when currency = 'USD' then 'USD' else 'INR' end cur,
  case when no_due then issue_date else due_date end due,
  slashed and (extract(day from issue_date) <= 12 or (not no_due and extract(day from due_date) <= 12)) unsure from document_facts),
graded as (select *, abs(subtotal + tax - got) <= 0.05 math_ok,
  cast((case when num is null then 0 else 25 end + 25 + case when unsure then 8 else 15 end + case when gstin is null then 10 else 15 end
  + case when abs(subtotal + tax - got) <= 0.05 then 10 else 0 end + 10) * 0.01 as decimal(3,2)) conf from read),
extracted as (select *, conf < 0.85 or num is null or not math_ok ambiguous from graded)"""
DOCUMENT_FIELDS = f"""{_DOCS} select invoice_id, num invoice_number, name customer_name, gstin tax_id, po po_number, issue_date, due due_date, got total_amount, subtotal subtotal_amount,
tax tax_amount, cur currency, conf confidence, ambiguous is_ambiguous, case when ambiguous then 'VALIDATION_REQUIRED' else 'VALIDATED' end ocr_status from extracted"""
IDENTIFIERS_IN_DOCUMENTS = """select doc_id, coalesce(nullif(regexp_extract(text, '\\b([0-9]{2}[A-Z]{5}[0-9]{4}[A-Z]{1}[1-9A-Z]{1}Z[0-9A-Z]{1})\\b', 1), ''),
nullif(regexp_extract(text, '\\b((?:GB|DE|FR|IT|ES)[0-9A-Z]{8,12})\\b', 1), '')) tax_id, nullif(regexp_extract(text, '\\b([A-Z]{5}[0-9]{4}[A-Z]{1})\\b', 1), '') pan,
nullif(regexp_extract(text, '(?i)\\b(INV[/-][A-Za-z0-9\\-_/]{3,25})\\b', 1), '') invoice_word from documents"""
_FILES = """, named as (select *, cast(invoice_id as varchar) || case when invoice_id % 11 = 0 then '.png' when invoice_id % 17 = 0 then '.exe' else '.pdf' end base from extracted),
files as (select *, base file_name from named union all select *, 'copy-' || base from named where invoice_id % 9 = 0),
screened as (select *, case when invoice_id % 5 = 0 or invoice_id % 7 = 0 then null else 'application/pdf' end mime_type, case when invoice_id % 11 = 0 then '.png' when invoice_id % 17 = 0 then '.exe' else '.pdf' end extension,
  case when invoice_id % 11 <> 0 and invoice_id % 17 = 0 then 'EXTENSION_NOT_ALLOWED' when invoice_id % 5 = 0 then 'ACTIVE_CONTENT' when invoice_id % 7 = 0 then 'UNSUPPORTED_SIGNATURE'
  when invoice_id % 11 = 0 then 'EXTENSION_CONTRADICTS_TYPE' end file_error from files)"""
DOCUMENT_SCREEN = f"{_DOCS}{_FILES} select file_name, mime_type, extension, file_error from screened"
DOCUMENT_JOB = f"""{_DOCS}{_FILES} select company_id, case when ambiguous then 'VALIDATION_REQUIRED' else 'VALIDATED' end ocr_status, count(*) documents, cast(sum(got) as decimal(18,2)) total
from (select distinct on (company_id, invoice_id) * from screened where file_error is null) group by 1, 2"""
DRAFTS = f"""{_DOCS.replace(ctes('document_facts'), ctes('document_facts', 'customers', 'aliases', 'identifiers'))}{_FILES}{_SEARCH},
fresh as (select distinct on (company_id, invoice_id) * from screened where file_error is null and num is not null and got > 0 and invoice_id % 3 <> 0),
hits as (select q.company_id, q.q, min(t.customer_id) hit from (select distinct company_id, coalesce(gstin, name) q from fresh) q join texts t on q.company_id = t.company_id and contains(t.t, lower(q.q))
  group by 1, 2 having count(distinct t.customer_id) = 1)
select f.company_id, f.num invoice_number, h.hit customer_id, issue_date, due due_date, got total_amount, 'DRAFT' status from fresh f left join hits h on f.company_id = h.company_id and coalesce(gstin, name) = h.q"""
BETTER = f"""{_DOCS} select invoice_id, case when ambiguous and num is null then 'SCAN-' || cast(invoice_id as varchar) else num end invoice_number,
cast(case when ambiguous and num is null then conf + 0.25 else conf end as decimal(3,2)) confidence from extracted"""
REFRESH = f"""{_DOCS} select i.invoice_id, case when i.invoice_id % 2 = 0 then coalesce(e.num, i.invoice_number) else i.invoice_number end invoice_number, i.issue_date,
case when i.invoice_id % 2 = 0 then e.due else i.due_date end due_date, case when i.invoice_id % 2 = 0 then e.got else i.total_amount end total_amount,
case when i.invoice_id % 2 = 0 then e.got else i.outstanding_amount end outstanding_amount, case when i.invoice_id % 2 = 0 then 'DRAFT' else i.status end status
from invoices i join extracted e on i.invoice_id = e.invoice_id"""
PROMOTE = f"""{ctes('invoices', 'customers')}, x as (select i.*, case when i.invoice_id % 2 = 0 then 'DRAFT' else i.status end st, i.invoice_id % 3 = 0 asked, c.is_archived gone,
  case when i.invoice_id % 4 = 0 then 'NEW-' || cast(i.invoice_id as varchar) else i.invoice_number end num, case when i.invoice_id % 8 = 0 then i.issue_date - 3 else i.due_date end due
  from invoices i join customers c on i.customer_id = c.customer_id),
y as (select *, case when not asked then null when invoice_id % 5 = 0 then 'CUSTOMER_NOT_FOUND' when gone then 'CUSTOMER_ARCHIVED' when st <> 'DRAFT' then 'NOT_A_DRAFT'
  when due < issue_date then 'DUE_BEFORE_ISSUE' else 'ACCEPTED' end promotion from x)
select invoice_id, case when promotion = 'ACCEPTED' then num else invoice_number end invoice_number, case when promotion = 'ACCEPTED' then due else due_date end due_date,
cast(case when promotion = 'ACCEPTED' and invoice_id % 9 = 0 then 10 else total_amount end as decimal(14,2)) total_amount,
cast(case when promotion = 'ACCEPTED' and invoice_id % 9 = 0 then 10 else outstanding_amount end as decimal(14,2)) outstanding_amount,
case when promotion = 'ACCEPTED' then 'PENDING' else st end status, promotion from y"""

# --- listings -------------------------------------------------------------------------------------

CONTEXT = f"""{ctes('payments')} select payment_id, coalesce(nullif(payer_raw_name, ''), case when payment_id % 13 = 0 then 'NAME ' || payment_id end) payer_raw_name,
coalesce(nullif(payment_reference, ''), case when payment_id % 13 = 0 then 'REF' || payment_id end) payment_reference,
coalesce(nullif(bank_account_number, ''), case when payment_id % 13 = 0 then '123456789' end) bank_account_number,
case when payment_id % 13 = 0 then 'BANK ROW' else narration end narration,
case when payment_id % 26 = 0 then 'DEBIT' else 'CREDIT' end transaction_type from payments"""
UNRECONCILED = f"{ctes('payments')} select payment_id, company_id, status from payments where status = 'UNRECONCILED'"
ELIGIBLE = f"{ctes('payments')} select payment_id, company_id, unallocated_amount from payments where status in ('UNRECONCILED', 'PARTIALLY_RECONCILED') and unallocated_amount > 0"
LIST_PAYMENTS = f"""{ctes('payments')} select payment_id, company_id, payment_date, amount from payments where status = 'UNRECONCILED' and payment_date between date '1997-01-01' and date '2000-12-31'
and amount between 1000 and 400000 and (payment_reference ilike '%neft%' or narration ilike '%neft%' or payer_raw_name ilike '%neft%')"""
COMPANY_PAGES = f"""{ctes('payments')} select * from (select company_id, payment_id, payment_date, row_number() over (partition by company_id order by payment_date desc, payment_id) place
from payments where status = 'UNRECONCILED') where place between 41 and 60"""
CUSTOMER_ORDER = f"{ctes('customers')} select customer_id, company_id, row_number() over (partition by company_id order by name, customer_id) place from customers where not is_archived"
_BATCHES = f"""{ctes('statement_events')}, batches as (select *, row_number() over (partition by company_id order by last_date desc, batch_id desc) place from (select company_id, file_id batch_id, count(*) transactions,
min(day) first_date, max(day) last_date from statement_events group by 1, 2))"""
BATCHES = f"{_BATCHES} select * from batches"
BATCH_ROWS = f"""{_BATCHES} select company_id, event_id, day transaction_date, row_number() over (partition by company_id order by day, event_id) place
from statement_events e where exists (select 1 from batches b where b.company_id = e.company_id and b.batch_id = e.file_id and place = 1)"""
BY_ID = f"{ctes('payments', 'invoices')} select payment_id, company_id, status from payments p where exists (select 1 from invoices i where i.company_id = p.company_id and i.invoice_id = p.payment_id and i.status = 'PENDING')"
NAME_LOOKUP = f"{ctes('customers')} select customer_id, company_id from customers where name is not null"
ALIAS_LOOKUP = f"""{ctes('aliases')} select company_id, customer_id, alias_name from aliases a
where exists (select 1 from aliases k where k.company_id + k.customer_id % 2 = a.company_id and lower(trim(k.alias_name)) = lower(trim(a.alias_name)))"""
IDENTIFIER_LOOKUP = f"""{ctes('customers', 'identifiers')} select company_id, customer_id, identifier_type, identifier_value from identifiers i
where exists (select 1 from customers c where c.company_id = i.company_id and cast(900000000 + c.customer_id as varchar) = lower(trim(i.identifier_value)))"""
REFERENCE_LOOKUP = f"""{ctes('payments')} select payment_id, company_id, payment_reference from payments p where exists (select 1 from payments k where k.company_id = p.company_id and upper(k.payment_reference) = p.payment_reference)"""
PAYMENT_PAGE = f"{ctes('payments')} select payment_id, payment_date from payments where status = 'UNRECONCILED' order by payment_date desc, payment_id limit 50 offset 100"
LIST_TRANSACTIONS = f"""{ctes('statement_events')} select event_id, file_id batch_id, day transaction_date, amount, 'CREDIT' transaction_type from statement_events
where is_credit and day between date '2024-01-03' and date '2024-01-20'"""
LIST_INVOICES = f"""{ctes('invoices')} select invoice_id, company_id, outstanding_amount from invoices where status = 'PENDING' and not is_archived and issue_date >= date '1996-01-01'
and due_date <= date '1999-06-30' and outstanding_amount > 0"""
LIST_DOCUMENTS = f"{ctes('document_facts')} select invoice_id, company_id, 'VALIDATED' ocr_status from document_facts where not no_number and invoice_id % 2 = 0"
LIST_CUSTOMERS = f"{ctes('customers')} select customer_id, company_id, name from customers where not is_archived"
SEARCH_CUSTOMERS = f"""{ctes('customers', 'aliases', 'identifiers')} select customer_id, company_id from customers c where not is_archived and (name ilike '%bbf%' or tax_id ilike '%bbf%' or email ilike '%bbf%'
or phone ilike '%bbf%' or customer_id in (select customer_id from aliases where alias_name ilike '%bbf%') or customer_id in (select customer_id from identifiers where identifier_value ilike '%bbf%'))"""
SEARCH_INVOICES = f"""{ctes('invoices', 'customers')} select invoice_id, company_id from invoices where not is_archived and (invoice_number ilike '%0012%'
or customer_id in (select customer_id from customers where name ilike '%0012%' or tax_id ilike '%0012%'))"""
LOOKUP = f"{ctes('invoices')} select invoice_id, invoice_number from invoices where invoice_id % 4 = 1"
OPEN_INVOICES = f"""{ctes('invoices')} select invoice_id, company_id, customer_id, currency, outstanding_amount from invoices
where not is_archived and status in ('PENDING', 'PARTIALLY_PAID') and outstanding_amount > 0"""
BY_STATUS = f"{ctes('payments')} select company_id, status, count(*) payments from payments group by 1, 2"
PAGE_TOTALS = f"{ctes('payments')} select company_id, count(*) total, cast(ceil(count(*) / 50.0) as bigint) pages from payments group by 1"
DETAIL = f"""{ctes('invoices', 'customers')} select invoice_id, c.name customer_name, c.tax_id customer_tax_id, c.is_archived customer_is_archived
from invoices i left join customers c on i.customer_id = c.customer_id"""
QUALITY = f"{ctes('payments')} select payment_id, 'BALANCE_NOT_CONSERVED' violations from payments where allocated_amount + unallocated_amount <> amount"
INVOICE_QUALITY = f"""{ctes('invoices')} select * from (select invoice_id, array_to_string(list_filter([case when invoice_id % 21 = 0 then 'DUE_BEFORE_ISSUE' end,
case when invoice_id % 22 = 0 then 'NEGATIVE_PAID' end, case when invoice_id % 22 = 0 then 'BALANCE_NOT_CONSERVED' end, case when invoice_id % 23 = 0 then 'CUSTOMER_REQUIRED' end],
lambda v: v is not null), ',') violations from invoices) where violations <> ''"""

# --- payer ----------------------------------------------------------------------------------------

_J = f"""{ctes('payments', 'customers', 'aliases', 'identifiers', 'invoices')},
verdicts as (select *, case when amount <= 0 then 'INVALID NON_POSITIVE_PAYMENT_AMOUNT' when not regexp_full_match(upper(trim(currency)), '[A-Z]{{3}}') then 'INVALID INVALID_CURRENCY_CODE'
  when transaction_type = 'DEBIT' then 'INELIGIBLE DEBIT_TRANSACTION_INELIGIBLE' when allocated_amount < 0 then 'INVALID NEGATIVE_ALLOCATED_BALANCE'
  when unallocated_amount < 0 then 'INVALID NEGATIVE_UNALLOCATED_BALANCE' when allocated_amount + unallocated_amount <> amount then 'INVALID BALANCE_CONSERVATION_BREACH'
  when payment_date > date '2026-01-31' then 'INVALID FUTURE_TRANSACTION_DATE' when status = 'RECONCILED' or unallocated_amount = 0 then 'ALREADY_PROCESSED FULLY_RECONCILED'
  when status = 'IGNORED' then 'INELIGIBLE PAYMENT_MARKED_IGNORED' when status = 'PARTIALLY_RECONCILED' then 'ELIGIBLE PARTIAL_BALANCE_AVAILABLE'
  else 'ELIGIBLE READY_FOR_RECONCILIATION' end v from payments),
judged as (select * exclude (v), split_part(v, ' ', 1) intake_status, split_part(v, ' ', 2) intake_reason, v like 'ELIGIBLE%' is_eligible from verdicts)"""
INTAKE = f"{_J} select payment_id, company_id, intake_status, intake_reason, is_eligible, cast(case when is_eligible then unallocated_amount else 0 end as decimal(14,2)) effective_amount from judged"
CUSTOMER_CONTEXT = f"""{ctes('customers', 'aliases', 'identifiers')} select c.customer_id,
coalesce((select string_agg(alias_name, ',' order by alias_name) from aliases a where a.customer_id = c.customer_id), '') aliases,
coalesce((select string_agg(identifier_type || '=' || identifier_value, ',' order by identifier_type, identifier_value) from identifiers i where i.customer_id = c.customer_id and is_active), '') identifiers
from customers c"""

_P = f"""{_J},
pp as (select payment_id, company_id, {clean('payer_raw_name')} pname, {ident('payer_raw_identifier')} payer, {ident('bank_account_number')} acc, {ident('payment_reference')} ref,
  {vpas('narration')} vp, {accounts('narration')} ac, {words(clean("coalesce(payer_raw_name, '') || ' ' || coalesce(narration, '')"))} ptoks from judged where is_eligible),
cc as (select company_id, customer_id, name, {legal(clean('name'))} lname, {ident('tax_id')} tax,
  {words(clean("name || ' ' || coalesce((select string_agg(alias_name, ' ' order by alias_name) from aliases a where a.customer_id = c.customer_id), '')"))} ctoks from customers c where not is_archived),
idn as (select i.*, {ident('identifier_value')} norm from identifiers i join customers c on i.customer_id = c.customer_id where i.is_active and not c.is_archived),
coords as (select payment_id, customer_id, norm, identifier_type ty, identifier_value val, case when norm = payer then 'payer_raw_identifier' when norm = acc then 'bank_account_number'
  when list_contains(vp, norm) then 'narration_extracted_vpa' else 'narration_extracted_account' end source_field
  from pp join idn on pp.company_id = idn.company_id and norm <> '' and (norm = payer or norm = acc or list_contains(vp, norm) or list_contains(ac, norm))),
keyed as (select payment_id, customer_id, case when source_field = 'narration_extracted_vpa' then 'EXACT_UPI_VPA' when source_field = 'narration_extracted_account' then 'EXACT_BANK_ACCOUNT'
  when ty = 'VIRTUAL_ACCOUNT' then 'EXACT_VIRTUAL_ACCOUNT' when source_field = 'payer_raw_identifier' and (contains(val, '@') or ty = 'UPI_VPA') then 'EXACT_UPI_VPA' else 'EXACT_BANK_ACCOUNT' end evidence_type,
  source_field, val matched_value, cast(case when source_field like 'narration%' then 95 else 100 end as decimal(5,2)) weight, norm from coords
  union all select pp.payment_id, a.customer_id, 'EXACT_ALIAS', 'payer_raw_name', min(alias_name), cast(85 as decimal(5,2)), null from pp join aliases a on pp.company_id = a.company_id
    join customers c on a.customer_id = c.customer_id where not c.is_archived and pname <> '' and pname = {clean('alias_name')} group by 1, 2
  union all select payment_id, customer_id, 'NORMALIZED_LEGAL_NAME', 'payer_raw_name', name, cast(75 as decimal(5,2)), null from pp join cc on pp.company_id = cc.company_id and pname <> '' and {legal('pname')} = lname
  union all select payment_id, customer_id, 'REFERENCE_MATCH', 'payment_reference', (select tax_id from customers c where c.customer_id = cc.customer_id), cast(50 as decimal(5,2)), null
    from pp join cc on pp.company_id = cc.company_id and ref <> '' and ref = tax and length(tax) >= 5 and upper(tax) not in ('PENDING')),
tokens as (select payment_id, customer_id, array_to_string(list_sort(m), ' ') matched_value,
  cast(least(4500, 2000 + (2500 * len(m)) // n + case when 2 * ((2500 * len(m)) % n) > n or (2 * ((2500 * len(m)) % n) = n and ((2500 * len(m)) // n) % 2 = 1) then 1 else 0 end) * 0.01 as decimal(5,2)) weight
  from (select payment_id, customer_id, list_intersect(ctoks, ptoks) m, len(ctoks) n from pp join cc on pp.company_id = cc.company_id)
  where n > 0 and len(m) * 10 >= n * 3 and (len(m) >= 2 or len(list_filter(m, lambda w: length(w) >= 5)) > 0)),
signals as (select payment_id, customer_id, evidence_type, weight, norm from keyed union all
  select payment_id, customer_id, 'NARRATION_TOKEN_OVERLAP', weight, null from tokens t where not exists (select 1 from keyed k where k.payment_id = t.payment_id and k.customer_id = t.customer_id
  and k.evidence_type <> 'REFERENCE_MATCH')),
sums as (select payment_id, customer_id, cast(max(weight) * 10000 as bigint) + cast((sum(weight) - max(weight)) * 500 as bigint) u, list(norm) filter (norm is not null) coords,
  bool_or(evidence_type in ('EXACT_ALIAS', 'NORMALIZED_LEGAL_NAME')) named from signals group by 1, 2),
cand as (select s.*, c.name, cast(least(10000, u // 100 + case when u % 100 > 50 or (u % 100 = 50 and (u // 100) % 2 = 1) then 1 else 0 end) * 0.01 as decimal(5,2)) score
  from sums s join customers c on s.customer_id = c.customer_id),
ranked as (select *, row_number() over (partition by payment_id order by score desc, name, customer_id) rk from cand)"""
KEY_SIGNALS = f"{_P} select payment_id, customer_id, evidence_type, source_field, matched_value, weight from keyed"
TOKEN_SIGNALS = f"{_P} select payment_id, customer_id, matched_value, weight from tokens"
PAYER_CANDIDATES = f"{_P} select payment_id, customer_id, score composite_score, rk rank from ranked"
PAYERS = f"""{_P}, decided as (select j.payment_id, j.company_id, a.customer_id, a.score one, a.name top_customer, b.name runner_up, b.score two, case when not j.is_eligible then 'NOT_ELIGIBLE ' || j.intake_reason
  when a.score is null then 'UNKNOWN NO_RECOGNIZABLE_COUNTERPARTY_EVIDENCE' when len(a.coords) > 0 and len(b.coords) > 0 and not list_has_any(a.coords, b.coords) then 'CONFLICTING CONFLICTING_DIRECT_IDENTIFIERS'
  when len(a.coords) > 0 and b.named and b.score >= 70 then 'CONFLICTING CONFLICTING_COORDINATE_AND_NAME' when a.score < 30 then 'UNKNOWN INSUFFICIENT_EVIDENCE_SCORE'
  when a.score < 70 then 'AMBIGUOUS LOW_CONFIDENCE_COUNTERPARTY_MATCH' when a.score - b.score < 15 then 'AMBIGUOUS CLOSE_SCORE_COUNTERPARTY_AMBIGUITY'
  else 'IDENTIFIED DETERMINISTIC_COUNTERPARTY_IDENTIFIED' end d
  from judged j left join ranked a on j.payment_id = a.payment_id and a.rk = 1 left join ranked b on j.payment_id = b.payment_id and b.rk = 2),
identified as (select payment_id, company_id, split_part(d, ' ', 1) payer_status, split_part(d, ' ', 2) payer_reason, case when d like 'IDENTIFIED%' then customer_id end customer_id,
  cast(case when d like 'NOT_ELIGIBLE%' or d like 'CONFLICTING%' then 0 else coalesce(one, 0) end as decimal(5,2)) payer_score, top_customer, one top_score, runner_up, two runner_up_score from decided)
select payment_id, company_id, payer_status, payer_reason, customer_id, payer_score, top_customer, top_score, runner_up, runner_up_score from identified"""
WIDE_PAYERS = PAYERS.replace("a.score - b.score < 15", "a.score - b.score < 45")
OVERRIDES = f"""{_J} select payment_id, case when payment_id % 10 = 0 and payment_id % 20 <> 0 and is_eligible then true_customer_id end customer_id,
payment_id % 10 = 0 and payment_id % 20 <> 0 and true_customer_id % 41 = 0 customer_is_archived,
case when payment_id % 20 = 0 then 'CUSTOMER_NOT_FOUND' when payment_id % 10 = 0 then 'APPLIED' end override_status from judged"""

# --- candidates -----------------------------------------------------------------------------------


def _tokens(x: str) -> str:
    return f"regexp_extract_all(upper(coalesce({x}, '')), '\\b[A-Za-z0-9][A-Za-z0-9\\-_/]{{2,}}\\b')"


def _named_in(x: str) -> str:
    toks = _tokens(x)
    return (f"(contains(upper(coalesce({x}, '')), upper(invoice_number)) or list_contains(list_transform({toks}, lambda t: {token_norm('t')}), {token_norm('invoice_number')}) "
            f"or list_contains({toks}, {token_norm('invoice_number')}))")


def pairs(sql: dict, assigned: str, lookback: int, k: int) -> str:
    """CTEs ap (payments), pr (evaluated pairs with reasons), kept (ranked passing pairs)."""
    base = _J.replace(ctes('payments', 'customers', 'aliases', 'identifiers', 'invoices'), ctes('payments', 'customers', 'aliases', 'identifiers', 'invoices', sql=sql))
    return f"""{base}, ap as (select j.*, {assigned} from judged j),
ups as (select *, case when not is_eligible then 'NOT_ELIGIBLE' when customer_id is null then 'CUSTOMER_UNRESOLVED' end upstream, unallocated_amount eff from ap),
opened as (select company_id, customer_id, invoice_id, invoice_number, issue_date, due_date, total_amount, paid_amount, outstanding_amount, currency icur from invoices
  where not is_archived and status in ('PENDING', 'PARTIALLY_PAID') and outstanding_amount > 0),
pr0 as (select payment_id, u.company_id, u.customer_id, eff, currency, payment_date, archived, narration, payment_reference, invoice_id, invoice_number, issue_date, due_date, total_amount, paid_amount,
  outstanding_amount, icur, {_named_in('narration')} in_narration, {_named_in('narration')} or {_named_in('payment_reference')} is_ref, payment_date - due_date gap, eff = outstanding_amount is_exact,
  eff <> outstanding_amount and eff = total_amount and paid_amount > 0 is_orig from ups u join opened o on u.company_id = o.company_id and u.customer_id = o.customer_id where upstream is null),
pr1 as (select *, eff < outstanding_amount and not is_orig is_part from pr0),
pr as (select *, cast((case when is_ref then 40000 else 0 end + case when is_exact then 35000 when is_orig then 25000 when is_part then 15000 else 0 end + case when issue_date <= payment_date then 10000 else 0 end
  + case when abs(gap) <= 7 then 10000 when abs(gap) <= 30 then 5000 else 2000 end + least(990, greatest(0, gap))) * 0.001 as decimal(7,3)) prio,
  case when archived then 'CUSTOMER_ARCHIVED,' else '' end || case when issue_date > payment_date then 'NON_CAUSAL_DATE,' else '' end
  || case when payment_date - issue_date > {lookback} and not is_ref then 'DATE_OUT_OF_WINDOW,' else '' end reasons from pr1 where icur = currency),
passing as (select *, row_number() over (partition by payment_id order by prio desc, is_exact desc, is_ref desc, due_date, invoice_id) rn from pr where reasons = ''),
kept as (select * from passing where rn <= {k}),
heads as (select u.*, (select count(*) from pr where pr.payment_id = u.payment_id) n_eval, (select count(*) from pr0 where pr0.payment_id = u.payment_id and icur <> currency) n_other,
  (select count(*) from passing q where q.payment_id = u.payment_id) n_pass, (select count(*) from kept q where q.payment_id = u.payment_id) n_kept from ups u),
uni as (select *, case when n_kept > 0 then 'SUCCESS' when upstream is not null then upstream when n_eval = 0 and n_other > 0 then 'CURRENCY_MISMATCH' when n_eval > n_kept then 'ALL_EXCLUDED'
  else 'NO_ELIGIBLE_INVOICES' end status_code, n_pass > n_kept trunc from heads)"""


_ASSIGNED = "case when payment_id % 29 <> 0 then true_customer_id end customer_id, true_customer_id % 41 = 0 archived"
_TIGHT = pairs(SQL, _ASSIGNED, 365, 2)
_TIGHT_ROUND = pairs(ROUND_SQL, _ASSIGNED, 365, 2)
_WIDE_ROUND = pairs(ROUND_SQL, _ASSIGNED, 1500, 30)
_ALL = pairs(SQL, "true_customer_id customer_id, false archived", 365, 30)

GATES = f"""{_J}, own as (select j.payment_id, j.payment_date pd, j.currency pcur, j.narration, j.payment_reference, j.unallocated_amount eff, true_customer_id % 41 = 0 customer_archived, i.*, v
  from judged j join invoices i on j.payment_id = i.invoice_id cross join range(16) r(v)),
ver as (select payment_id, pd, pcur, eff, customer_archived, v, invoice_id * 16 + case when v = 13 then 0 else v end id, v = 3 or is_archived archived, case when v = 4 then 'usdx' else currency end cur,
  case when v = 5 then 'CANCELLED' else status end status, case v when 6 then 0 when 14 then 10 when 15 then eff + 1 else total_amount end total,
  case v when 7 then -1 when 8 then 0 when 14 then 10 when 15 then eff + 1 else outstanding_amount end bal, case when v = 8 then total_amount when v = 9 then paid_amount + 1 when v >= 14 then 0 else paid_amount end paid,
  case v when 11 then pd + 5 when 12 then pd - 2000 else issue_date end iss, case v when 10 then issue_date - 1 when 11 then pd + 10 when 12 then pd - 1990 else due_date end due,
  {_named_in('narration')} or {_named_in('payment_reference')} is_ref from own),
g as (select *, list_filter(case when v = 13 then ['DUPLICATE_CANDIDATE'] else [case when v = 1 then 'TENANT_MISMATCH' end, case when v = 2 then 'CUSTOMER_MISMATCH' end, case when customer_archived then 'CUSTOMER_ARCHIVED' end,
  case when archived then 'ARCHIVED_INVOICE' end, case when upper(trim(cur)) <> upper(trim(pcur)) or not regexp_matches(upper(trim(cur)), '^[A-Z]{{3}}$') then 'CURRENCY_MISMATCH' end,
  case when status not in ('PENDING', 'PARTIALLY_PAID') then 'STATUS_INELIGIBLE' end, case when total <= 0 then 'NON_POSITIVE_TOTAL_AMOUNT' end, case when bal < 0 then 'NEGATIVE_OUTSTANDING_BALANCE' end,
  case when bal = 0 then 'ZERO_OUTSTANDING_BALANCE' end, case when paid + bal <> total then 'BALANCE_CONSERVATION_BREACH' end, case when bal < 100 then 'AMOUNT_BELOW_MINIMUM' end,
  case when bal > 250000 then 'AMOUNT_ABOVE_MAXIMUM' end, case when bal > eff then 'EXCEEDS_PAYMENT_AMOUNT' end, case when due < iss or iss > pd then 'NON_CAUSAL_DATE' end,
  case when due >= iss and pd - iss > 365 and not is_ref then 'DATE_OUT_OF_WINDOW' end, case when not is_ref then 'REFERENCE_MISMATCH' end] end, lambda x: x is not null) reasons from ver),
h as (select payment_id, string_agg(r || '=' || c, ',' order by r || '=' || c) breakdown from (select payment_id, r, count(*) c from (select payment_id, unnest(reasons) r from g) group by 1, 2) group by 1)
select g.payment_id, count(*) total_evaluated, count(*) filter (len(reasons) = 0) total_retained, coalesce(any_value(breakdown), '') breakdown,
coalesce(string_agg(id, ',' order by id) filter (len(reasons) = 0), '') retained from g left join h on g.payment_id = h.payment_id group by 1"""
_GEN = """, gen as (select *, row_number() over (partition by payment_id order by prio desc, is_exact desc, is_ref desc, due_date, invoice_id) g from pr)"""
GENERATED = f"""{_TIGHT}{_GEN} select payment_id, company_id, coalesce(upstream, case when n_eval > 0 then 'SUCCESS' when n_other > 0 then 'CURRENCY_MISMATCH' else 'NO_ELIGIBLE_INVOICES' end) status_code,
n_eval total_eligible_invoices, n_eval > 3 truncated, case when n_eval = 0 then n_other else 0 end currency_mismatches_detected,
coalesce((select string_agg(invoice_id, ',' order by g) from gen where gen.payment_id = h.payment_id and g <= 3), '') candidates,
coalesce((select string_agg(prio, ',' order by g) from gen where gen.payment_id = h.payment_id and g <= 3), '') priorities from heads h"""
CANDIDATE_SIGNALS = f"""{_TIGHT}{_GEN}, b as (select * from gen where g <= 30)
select payment_id, invoice_id, 'INVOICE_NUMBER_MATCH' evidence_type, 'STRONG' signal_strength, case when in_narration then 'narration' else 'payment_reference' end source_field, cast(40 as decimal(5,2)) weight from b where is_ref
union all select payment_id, invoice_id, 'EXACT_AMOUNT_MATCH', 'STRONG', 'amount', 35 from b where is_exact
union all select payment_id, invoice_id, 'EXACT_ORIGINAL_AMOUNT_MATCH', 'MEDIUM', 'amount', 25 from b where is_orig
union all select payment_id, invoice_id, 'PARTIAL_AMOUNT_COMPATIBLE', 'MEDIUM', 'amount', 15 from b where is_part
union all select payment_id, invoice_id, 'DATE_RELEVANCE', case when abs(gap) <= 7 then 'STRONG' when abs(gap) <= 30 then 'MEDIUM' else 'WEAK' end, 'payment_date',
case when issue_date <= payment_date then 10 else 0 end + case when abs(gap) <= 7 then 10 when abs(gap) <= 30 then 5 else 2 end from b"""
FILTERED = f"""{_TIGHT}, hits as (select payment_id, r, count(*) c from (select payment_id, unnest(string_split(rtrim(reasons, ','), ',')) r from pr where reasons <> '') group by 1, 2
  union all select payment_id, 'TRUNCATED_BY_LIMIT', count(*) from passing where rn > 2 group by 1)
select payment_id, company_id, status_code, n_eval total_evaluated, n_kept total_retained, n_eval - n_kept total_excluded, case when n_eval = 0 then n_other else 0 end currency_mismatches_detected, trunc is_truncated,
coalesce((select string_agg(r || '=' || c, ',' order by r || '=' || c) from hits where hits.payment_id = u.payment_id), '') breakdown,
coalesce((select string_agg(invoice_id, ',' order by rn) from kept where kept.payment_id = u.payment_id), '') candidates from uni u"""
FILTERED_ALL = FILTERED.replace(_TIGHT, pairs(SQL, _ASSIGNED, 365, 1_000_000)).replace("rn > 2", "rn > 1000000")
EXCLUDED = f"""{_TIGHT}, gone as (select payment_id, invoice_id, rtrim(reasons, ',') reasons, due_date, outstanding_amount, invoice_number from pr where reasons <> ''
  union all select payment_id, invoice_id, 'TRUNCATED_BY_LIMIT', due_date, outstanding_amount, invoice_number from passing where rn > 2)
select payment_id, invoice_id, reasons, row_number() over (partition by payment_id order by due_date, outstanding_amount desc, invoice_number, invoice_id) position from gone"""
PREFILTER = f"""{_TIGHT} select * from (select payment_id, invoice_id, row_number() over (partition by payment_id order by due_date, issue_date, invoice_number, invoice_id) position from pr1
where icur = upper(trim(currency)) and not archived and issue_date <= payment_date and payment_date - issue_date <= 365) where position <= 2"""


def _one_to_one(word: str, partial: bool) -> str:
    hit, other = ("outstanding_amount > eff", "outstanding_amount = eff") if partial else ("outstanding_amount = eff", "outstanding_amount > eff")
    other_reason = "EXACT_MATCH_DETECTED" if partial else "PARTIAL_PAYMENT_DETECTED"
    return f"""{_TIGHT_ROUND}, facts as (select payment_id, invoice_id, is_ref, row_number() over (partition by payment_id order by is_ref desc, abs(gap), invoice_number, invoice_id) f from kept where {hit}),
c as (select u.*, (select count(*) from facts where facts.payment_id = u.payment_id) m, (select count(*) from passing q where q.payment_id = u.payment_id and rn > 2 and {hit}) o,
  (select count(*) from kept q where q.payment_id = u.payment_id and {other}) x, (select count(*) from kept q where q.payment_id = u.payment_id and outstanding_amount < eff) s,
  (select is_ref from facts where facts.payment_id = u.payment_id and f = 1) ref1 from uni u),
d as (select *, case when eff <= 0 then 'NO PAYMENT_INELIGIBLE' when status_code = 'CUSTOMER_UNRESOLVED' then 'NO CUSTOMER_UNRESOLVED' when status_code = 'NOT_ELIGIBLE' then 'NO PAYMENT_INELIGIBLE'
  when status_code = 'CURRENCY_MISMATCH' then 'NO CURRENCY_MISMATCH' when n_kept = 0 then 'NO NO_RETAINED_CANDIDATES' when m + o = 0 and x > 0 and s = 0 then 'NO {other_reason}'
  when m + o = 0 and s > 0 and x = 0 then 'NO OVERPAYMENT_DETECTED' when m + o = 0 then 'NO {'NO_CANDIDATE_ELIGIBLE_FOR_PARTIAL' if partial else 'NO_CANDIDATE_MATCHES_AMOUNT'}'
  when m + o > 1 and o > 0 then 'AMBIGUOUS TRUNCATED_UNIVERSE_AMBIGUITY' when m + o > 1 then 'AMBIGUOUS {'MULTIPLE_PARTIAL_CANDIDATES' if partial else 'MULTIPLE_EXACT_AMOUNT_MATCHES'}'
  when trunc and not coalesce(ref1, false) then 'AMBIGUOUS TRUNCATED_UNIVERSE_AMBIGUITY' when ref1 then 'ONE {word}_AMOUNT_WITH_REFERENCE_MATCH' else 'ONE {word}_AMOUNT_MATCH_FOUND' end v,
  eff <= 0 or status_code in ('CUSTOMER_UNRESOLVED', 'NOT_ELIGIBLE', 'CURRENCY_MISMATCH') stopped from c)
select payment_id, case split_part(v, ' ', 1) when 'NO' then 'NO_{word}_MATCH' when 'ONE' then '{word}_MATCH' else 'AMBIGUOUS_{word}_MATCH' end status, split_part(v, ' ', 2) reason_code,
case when stopped or n_kept = 0 then 0 else m + o end total_found, not stopped and trunc is_universe_truncated, case when stopped then 0 when n_kept = 0 then n_eval else n_kept end candidate_count_evaluated,
case when v like 'ONE%' then (select invoice_id from facts where facts.payment_id = d.payment_id and f = 1) end invoice_id,
case when v like 'AMB%' then coalesce((select string_agg(invoice_id, ',' order by f) from facts where facts.payment_id = d.payment_id), '') else '' end competing from d"""


EXACT = _one_to_one("EXACT", False)
PARTIAL = _one_to_one("PARTIAL", True)
EXACT_ALL, PARTIAL_ALL = (sql.replace(_TIGHT_ROUND, pairs(ROUND_SQL, _ASSIGNED, 365, 1_000_000)).replace("rn > 2", "rn > 1000000") for sql in (EXACT, PARTIAL))


def _sets(order: str, named: str, sizes: tuple[int, ...] | None = (2, 3, 4)) -> str:
    """CTE facts: sets of smaller candidates whose balances add up to the payment, of the given sizes or (None) of any."""
    pool = f""", pool as (select *, {named} named, row_number() over (partition by payment_id order by {order}) p from kept where outstanding_amount < eff)"""
    fields = {"ids": "invoice_id", "numbers": "invoice_number", "dues": "due_date", "gaps": "gap", "nameds": "named"}
    parts = []
    for k in sizes or ():
        names = [f"m{i}" for i in range(1, k + 1)]
        join = " ".join(f"join pool {b} on {a}.payment_id = {b}.payment_id and {a}.p < {b}.p" for a, b in zip(names, names[1:]))
        each = ", ".join(f"[{', '.join(f'{n}.{f}' for n in names)}] {c}" for c, f in fields.items())
        parts.append(f"select m1.payment_id, {k} size, {each} from pool m1 {join} where {' + '.join(f'{n}.outstanding_amount' for n in names)} = m1.eff")
    if sizes is None:
        first, more = (", ".join(template.format(c=c, f=f) for c, f in fields.items()) for template in ("[{f}] {c}", "list_append(g.{c}, m.{f})"))
        pool += f""", grown as (select payment_id, p, eff, 1 size, outstanding_amount::decimal(38,2) total, {first} from pool
  union all select g.payment_id, m.p, g.eff, g.size + 1, (g.total + m.outstanding_amount)::decimal(38,2), {more} from grown g join pool m on m.payment_id = g.payment_id and m.p > g.p and g.total + m.outstanding_amount <= g.eff)"""
        parts.append(f"select payment_id, size, {', '.join(fields)} from grown where size > 1 and total = eff")
    return f"""{pool},
sets as ({' union all '.join(parts)}),
facts0 as (select *, array_to_string(ids, '+') k, len(list_filter(nameds, lambda n: n)) refs, list_max(list_transform(gaps, lambda g: abs(g))) maxgap, list_min(dues) oldest, list_max(dues) newest,
  -list_sum(gaps) / size avgdays from sets)"""


_BY_DUE = ("due_date, invoice_number, invoice_id", "is_ref")
_BY_NUMBER = ("invoice_number, invoice_id", f"is_ref or contains({alnum('narration')}, {alnum('invoice_number')})")
MULTI = f"""{_WIDE_ROUND}{_sets(*_BY_DUE)},
facts as (select *, row_number() over (partition by payment_id order by refs > 0 desc, refs desc, size, maxgap, numbers, ids) f from facts0),
c as (select u.*, (select count(*) from facts where facts.payment_id = u.payment_id) m, (select count(*) from pool q where q.payment_id = u.payment_id) small,
  (select coalesce(sum(outstanding_amount), 0) from pool q where q.payment_id = u.payment_id) total, (select count(*) from kept q where q.payment_id = u.payment_id and is_exact) x,
  (select count(*) from kept q where q.payment_id = u.payment_id and outstanding_amount > eff) l, (select refs from facts where facts.payment_id = u.payment_id and f = 1) refs1 from uni u),
d as (select *, case when eff <= 0 then 'NO PAYMENT_INELIGIBLE' when status_code = 'CUSTOMER_UNRESOLVED' then 'NO CUSTOMER_UNRESOLVED' when status_code = 'NOT_ELIGIBLE' then 'NO PAYMENT_INELIGIBLE'
  when status_code = 'CURRENCY_MISMATCH' then 'NO CURRENCY_MISMATCH' when n_kept = 0 then 'NO NO_RETAINED_CANDIDATES' when small < 2 and x > 0 then 'NO EXACT_MATCH_DETECTED'
  when small = 0 and l > 0 then 'NO PARTIAL_MATCH_DETECTED' when small < 2 then 'NO INSUFFICIENT_CANDIDATES' when m = 0 and total < eff then 'NO UNDERPAYMENT_DETECTED'
  when m = 0 then 'NO NO_MULTI_INVOICE_COMBINATION_FOUND' when m > 1 then 'AMBIGUOUS MULTIPLE_MULTI_INVOICE_MATCHES' when refs1 > 0 then 'ONE MULTI_INVOICE_WITH_REFERENCE_MATCH'
  else 'ONE MULTI_INVOICE_MATCH_FOUND' end v, eff <= 0 or status_code in ('CUSTOMER_UNRESOLVED', 'NOT_ELIGIBLE', 'CURRENCY_MISMATCH') stopped from c)
select payment_id, case split_part(v, ' ', 1) when 'NO' then 'NO_MULTI_INVOICE_MATCH' when 'ONE' then 'MULTI_INVOICE_MATCH' else 'AMBIGUOUS_MULTI_INVOICE_MATCH' end status, split_part(v, ' ', 2) reason_code,
m total_found, case when stopped then 0 when n_kept = 0 then n_eval else n_kept end candidate_count_evaluated,
case when v like 'ONE%' then (select k from facts where facts.payment_id = d.payment_id and f = 1) end matched,
case when v like 'AMB%' then (select string_agg(k, ',' order by f) from facts where facts.payment_id = d.payment_id) else '' end competing from d"""

_COMB = f"""{_WIDE_ROUND}{_sets(*_BY_NUMBER)},
facts1 as (select *, row_number() over (partition by payment_id order by refs > 0 desc, refs desc, oldest, avgdays, size, maxgap, numbers, ids) f,
  row_number() over (partition by payment_id order by oldest, avgdays, size, numbers, ids) age, count(*) over (partition by payment_id, refs) same_refs, max(refs) over (partition by payment_id) most from facts0
  where payment_id not in (select payment_id from kept where is_exact)),
facts as (select * from facts1),
c as (select u.*, (select count(*) from facts where facts.payment_id = u.payment_id) m, (select count(*) from pool q where q.payment_id = u.payment_id) small,
  (select coalesce(sum(outstanding_amount), 0) from pool q where q.payment_id = u.payment_id) total, (select count(*) from kept q where q.payment_id = u.payment_id and is_exact) x,
  (select count(*) from kept q where q.payment_id = u.payment_id and outstanding_amount > eff) l, a.oldest o1, a.avgdays a1, b.oldest o2, b.avgdays a2, t.most, t.same_refs from uni u
  left join facts a on a.payment_id = u.payment_id and a.age = 1 left join facts b on b.payment_id = u.payment_id and b.age = 2 left join facts t on t.payment_id = u.payment_id and t.f = 1),
d as (select *, case when eff <= 0 then 'NO PAYMENT_INELIGIBLE' when customer_id is null then 'NO CUSTOMER_UNRESOLVED' when n_kept = 0 then 'NO NO_RETAINED_CANDIDATES' when x > 0 then 'NO EXACT_MATCH_DETECTED'
  when small < 2 and l = n_kept then 'NO PARTIAL_MATCH_DETECTED' when small < 2 then 'NO INSUFFICIENT_CANDIDATES' when m = 0 and total < eff then 'NO UNDERPAYMENT_DETECTED' when m = 0 then 'NO NO_COMBINATION_FOUND'
  when m = 1 then 'UNIQUE UNIQUE_COMBINATION_FOUND' when most > 0 and same_refs = 1 then 'PRIORITIZED REFERENCE_PRIORITIZED'
  when o1 < o2 or (o1 = o2 and a1 < a2) then 'PRIORITIZED FIFO_AGING_PRIORITIZED' else 'AMBIGUOUS MULTIPLE_COMBINATIONS_UNRESOLVED' end v from c)"""
COMBINATION = f"""{_COMB} select payment_id, split_part(v, ' ', 1) || '_COMBINATION_MATCH' status, split_part(v, ' ', 2) reason_code, m total_found, n_kept candidate_count_evaluated,
case when v like '%REFERENCE%' then 'REFERENCE_MATCH_PRIORITY' when v like '%FIFO%' then 'RULE_M3_FIFO_AGING' end applied_heuristic, v like 'AMB%' or v like 'PRIO%' requires_review,
case when v like '%FIFO%' then (select k from facts where facts.payment_id = d.payment_id and age = 1) when v like 'UNI%' or v like '%REFERENCE%' then (select k from facts where facts.payment_id = d.payment_id and f = 1) end matched,
coalesce((select string_agg(k, ',' order by case when v like '%FIFO%' and age = 1 then 0 else f end) from facts where facts.payment_id = d.payment_id), '') competing from d"""
COMBINATION_FACTS = f"""{_COMB} select facts.payment_id, size::bigint combination_size, k invoice_ids, oldest oldest_due_date, newest newest_due_date, round(avgdays, 6) average_days_to_due, maxgap max_gap, refs::bigint "references"
from facts join uni u on facts.payment_id = u.payment_id"""



def _any_size(sql: str, order: str, named: str) -> str:
    """The same over all candidates and sets of any size."""
    whole = pairs(ROUND_SQL, _ASSIGNED, 1500, 1_000_000)
    return sql.replace(_WIDE_ROUND, whole.replace("with", "with recursive", 1)).replace(_sets(order, named), _sets(order, named, None))


MULTI_ALL = _any_size(MULTI, *_BY_DUE)
COMBINATION_ALL = _any_size(COMBINATION, *_BY_NUMBER)
COMBINATION_FACTS = _any_size(COMBINATION_FACTS, *_BY_NUMBER)
SET_ROWS = MULTI_ALL[:MULTI_ALL.index(",\nfacts as (")] + " select payment_id, size::bigint combination_size, k invoice_ids from facts0"
COMBINATION_UNLISTED = f"select * exclude (competing), total_found <= 1 is_listing_complete from ({COMBINATION_ALL})"

# --- evidence -------------------------------------------------------------------------------------

_EV = f"""{_ALL},
txt as (select u.*, c.name, {clean('c.name')} cname, {clean('narration')} cnarr, {clean('payer_raw_name')} cpay, coalesce(narration, '') narr,
  nullif(trim(coalesce(nullif(bank_account_number, ''), nullif(payer_raw_identifier, ''))), '') account,
  regexp_extract_all(coalesce(narration, ''), '(?i)\\b(?:INV|BILL|REC)[-_A-Z0-9]{{3,30}}\\b') toks,
  nullif(regexp_extract(coalesce(narration, ''), '(?i)\\b[A-Z0-9]{{12,22}}\\b'), '') utr,
  case when regexp_matches(trim(coalesce(payment_reference, '')), '(?i)^(?:INV|BILL|REC)[-_A-Z0-9]{{3,30}}\\b') then [trim(payment_reference)] else [] end refs0
  from uni u join customers c on u.customer_id = c.customer_id),
pay as (select *, case when len(refs0) = 0 then list_transform(toks, lambda t: upper(t)) else list_concat(refs0, list_filter(list_transform(toks, lambda t: upper(t)), lambda t: not list_contains(refs0, t))) end refs,
  exists (select 1 from identifiers i where i.customer_id = txt.customer_id and is_active and identifier_type in ('BANK_ACCOUNT', 'VIRTUAL_ACCOUNT') and (suffix(identifier_value, account) or suffix(account, identifier_value))) own,
  list_sort(list_filter(list_intersect(list_distinct(string_split(cname, ' ')), list_distinct(list_concat(string_split(cnarr, ' '), string_split(cpay, ' ')))), lambda w: w <> '')) shared,
  (select min(alias_name) from aliases a where a.customer_id = txt.customer_id and (contains(cnarr, {clean('alias_name')}) or contains(cpay, {clean('alias_name')}))) hit,
  exists (select 1 from aliases a where a.customer_id = txt.customer_id) has_alias from txt),
owners as (select distinct p.payment_id, i.customer_id owner from pay p join identifiers i on p.company_id = i.company_id and i.identifier_value = p.account and i.customer_id <> p.customer_id
  and i.is_active and i.identifier_type in ('BANK_ACCOUNT', 'VIRTUAL_ACCOUNT') join customers c on i.customer_id = c.customer_id where not c.is_archived),
cnd as (select k.*, p.refs from kept k join pay p on k.payment_id = p.payment_id),
ev as (
select payment_id, cast(null as bigint) invoice_id, 'PAYMENT_REFERENCE' evidence_type, case when trim(coalesce(payment_reference, '')) <> '' then 'SUPPORTING' else 'MISSING' end classification,
  case when trim(coalesce(payment_reference, '')) <> '' then 'PRESENT' else 'ABSENT' end observed_result, 'PAYMENT' target_entity, nullif(trim(coalesce(payment_reference, '')), '') matched_value, 'payment.payment_reference' source from pay
union all select payment_id, null, 'INVOICE_NUMBER_IN_NARRATION', case when narr = '' then 'MISSING' else 'DIRECT' end, case when narr = '' then 'ABSENT' else 'MATCHED' end, 'PAYMENT',
  case when narr <> '' then array_to_string(toks, ', ') end, 'payment.narration' from pay where narr = '' or len(toks) > 0
union all select payment_id, null, 'UTR_IDENTIFIER', case when utr is null then 'MISSING' else 'SUPPORTING' end, case when utr is null then 'ABSENT' else 'EXTRACTED' end, 'PAYMENT', utr, 'payment.narration' from pay
union all select payment_id, null, 'BANK_ACCOUNT_IDENTIFIER', case when own then 'DIRECT' else 'MISSING' end, case when account is null then 'ABSENT' when own then 'MATCHED' else 'UNREGISTERED' end, 'CUSTOMER', account, 'payment.bank_account_number' from pay
union all select payment_id, null, 'BANK_ACCOUNT_IDENTIFIER', 'CONFLICTING', 'CONFLICT', 'CUSTOMER', cast(owner as varchar), 'payment.bank_account_number' from owners
union all select payment_id, null, 'CUSTOMER_NAME_TOKEN', case when len(shared) > 0 then 'SUPPORTING' else 'MISSING' end,
  case when len(shared) = 0 then 'ABSENT' when contains(case when cnarr <> '' then cnarr else cpay end, cname) then 'MATCHED' else 'TOKEN_OVERLAP' end, 'CUSTOMER',
  case when len(shared) = 0 then null when contains(case when cnarr <> '' then cnarr else cpay end, cname) then name else array_to_string(shared, ', ') end, 'payment.narration' from pay
union all select payment_id, null, 'CUSTOMER_ALIAS', case when hit is null then 'MISSING' else 'SUPPORTING' end, case when hit is null then 'ABSENT' else 'MATCHED' end, 'CUSTOMER', hit, 'payment.narration' from pay where has_alias
union all select payment_id, invoice_id, 'INVOICE_NUMBER_IN_NARRATION', case when list_contains(refs, invoice_number) then 'DIRECT' when len(refs) > 0 then 'CONFLICTING' else 'MISSING' end,
  case when list_contains(refs, invoice_number) then 'MATCHED' when len(refs) > 0 then 'CONFLICT' else 'ABSENT' end, 'INVOICE',
  case when list_contains(refs, invoice_number) then invoice_number when len(refs) > 0 then array_to_string(refs, ', ') end, 'payment.narration' from cnd
union all select payment_id, invoice_id, 'CURRENCY_CONSISTENCY', 'SUPPORTING', 'CONSISTENT', 'INVOICE', currency, 'candidate.currency' from cnd
union all select payment_id, invoice_id, case when eff = outstanding_amount then 'AMOUNT_EXACT_EQUALITY' when eff < outstanding_amount then 'AMOUNT_PARTIAL_COMPATIBLE' else 'AMOUNT_OVERPAYMENT' end,
  case when eff = outstanding_amount then 'DIRECT' else 'SUPPORTING' end, case when eff = outstanding_amount then 'EXACT_MATCH' when eff < outstanding_amount then 'PARTIAL_AMOUNT' else 'OVERPAYMENT_AMOUNT' end,
  'INVOICE', cast(eff as varchar), 'candidate.outstanding_amount' from cnd
union all select payment_id, invoice_id, 'DATE_CAUSALITY', 'SUPPORTING', 'CAUSAL', 'INVOICE', cast(payment_date as varchar), 'payment.payment_date' from cnd
union all select payment_id, invoice_id, 'DATE_PROXIMITY', case when abs(gap) <= 30 then 'SUPPORTING' else 'MISSING' end, case when abs(gap) <= 30 then 'PROXIMATE' else 'DISTANT' end, 'INVOICE', cast(abs(gap) as varchar), 'candidate.due_date' from cnd)"""
EVIDENCE = f"{_EV} select payment_id, invoice_id, evidence_type, classification, observed_result, target_entity, matched_value from ev"
EVIDENCE_COUNTS = f"""{_EV} select payment_id, count(*) total_items, count(*) filter (classification = 'DIRECT') total_direct, count(*) filter (classification = 'SUPPORTING') total_supporting,
count(*) filter (classification = 'MISSING') total_missing, count(*) filter (classification = 'CONFLICTING') total_conflicting from ev group by 1"""
NORMALIZED = f"""{_EV} select evidence_type, classification, source, case observed_result when 'MATCHED' then 'MATCH' when 'EXACT_MATCH' then 'MATCH' when 'CONSISTENT' then 'MATCH' when 'PRESENT' then 'PRESENT'
when 'EXTRACTED' then 'PRESENT' when 'CONFLICT' then 'CONFLICT' when 'ABSENT' then 'ABSENT' when 'DISTANT' then 'ABSENT' when 'UNREGISTERED' then 'ABSENT' else 'SUPPORTED' end result,
case when classification in ('MISSING', 'CONFLICTING') then 'NONE' when classification = 'DIRECT' then 'EXACT'
  when evidence_type in ('UTR_IDENTIFIER', 'CUSTOMER_ALIAS', 'AMOUNT_PARTIAL_COMPATIBLE', 'CURRENCY_CONSISTENCY', 'DATE_CAUSALITY') or observed_result = 'MATCHED' then 'MEDIUM' else 'LOW' end strength,
target_entity, count(*) items from ev group by all"""
_SCORE = f"""{_EV}, sc as (select k.payment_id, k.invoice_id, k.invoice_number, p.own and not exists (select 1 from owners o where o.payment_id = k.payment_id) s1, list_contains(p.refs, k.invoice_number) s2, k.is_exact s3,
  exists (select 1 from ev where ev.payment_id = k.payment_id and evidence_type in ('CUSTOMER_NAME_TOKEN', 'CUSTOMER_ALIAS') and observed_result = 'MATCHED') s4, abs(k.gap) <= 30 s5,
  len(p.refs) > 0 and not list_contains(p.refs, k.invoice_number) other_ref, exists (select 1 from owners o where o.payment_id = k.payment_id) taken, len(p.refs) = 0 no_ref
  from kept k join pay p on k.payment_id = p.payment_id),
scored as (select *, cast(case when s1 then 40 else 0 end + case when s2 then 35 else 0 end + case when s3 then 30 else 0 end + case when s4 then 20 else 0 end + case when s5 then 10 else 0 end as decimal(7,2)) raw from sc),
final as (select *, cast(least(100, raw) as decimal(5,2)) score, row_number() over (partition by payment_id order by least(100, raw) desc, invoice_number, invoice_id) rk from scored)"""
SCORES = f"""{_SCORE} select payment_id, invoice_id, rk rank, score total_score, raw raw_unclamped_score, other_ref or taken has_conflicting_evidence,
array_to_string(list_filter([case when s1 then 'IDENTIFIER_MATCH' end, case when s2 then 'INVOICE_NUMBER_MATCH' end, case when s3 then 'AMOUNT_EXACT_MATCH' end, case when s4 then 'CUSTOMER_NAME_MATCH' end,
case when s5 then 'DATE_PROXIMITY_MATCH' end], lambda v: v is not null), ',') signals from final"""
CONFIDENCE = f"""{_SCORE} select payment_id, invoice_id, rk rank, score confidence_score, case when score >= 90 then 'VERY_HIGH' when score >= 70 then 'HIGH' when score >= 40 then 'MEDIUM' when score > 0 then 'LOW' else 'NONE' end confidence_level,
s2 or s3 has_direct_evidence, other_ref or taken has_conflicting_evidence, no_ref or not s5 has_incomplete_evidence from final"""
ACCOUNT_CONFLICTS = f"""{_EV} select payment_id, string_agg(owner, ',' order by c.name, owner) owners from owners join customers c on owners.owner = c.customer_id group by 1"""

# identify the payer, then candidates, exact match and the best candidate's confidence
_IDENT = PAYERS.rsplit("select payment_id, company_id, payer_status", 1)[0]
_CHAIN = _EV.replace(_ALL, _IDENT.rstrip() + pairs(SQL, "(select i.customer_id from identified i where i.payment_id = j.payment_id) customer_id, false archived", 365, 30)[len(_J):])
_CHAIN = _CHAIN.replace("from uni u join customers c on u.customer_id = c.customer_id)", "from uni u left join customers c on u.customer_id = c.customer_id)")
# names of the identification step that the evidence step uses again
RECONCILED = f"""{_CHAIN.replace(', pay as (select *', ', pay as materialized (select *')}{_SCORE[len(_EV):]},
xf as (select payment_id, invoice_id, is_ref, count(*) over (partition by payment_id) m from kept where is_exact),
xc as (select u.*, coalesce((select max(m) from xf where xf.payment_id = u.payment_id), 0) m, (select count(*) from kept q where q.payment_id = u.payment_id and outstanding_amount > eff) x,
  (select count(*) from kept q where q.payment_id = u.payment_id and outstanding_amount < eff) s, (select bool_or(is_ref) from xf where xf.payment_id = u.payment_id) r from uni u),
xd as (select *, case when eff <= 0 then 'NO PAYMENT_INELIGIBLE' when status_code = 'CUSTOMER_UNRESOLVED' then 'NO CUSTOMER_UNRESOLVED' when status_code = 'NOT_ELIGIBLE' then 'NO PAYMENT_INELIGIBLE'
  when status_code = 'CURRENCY_MISMATCH' then 'NO CURRENCY_MISMATCH' when n_kept = 0 then 'NO NO_RETAINED_CANDIDATES' when m = 0 and x > 0 and s = 0 then 'NO PARTIAL_PAYMENT_DETECTED'
  when m = 0 and s > 0 and x = 0 then 'NO OVERPAYMENT_DETECTED' when m = 0 then 'NO NO_CANDIDATE_MATCHES_AMOUNT' when m > 1 then 'AMBIGUOUS MULTIPLE_EXACT_AMOUNT_MATCHES'
  when r then 'ONE EXACT_AMOUNT_WITH_REFERENCE_MATCH' else 'ONE EXACT_AMOUNT_MATCH_FOUND' end v from xc)
select xd.payment_id, xd.customer_id, case split_part(v, ' ', 1) when 'NO' then 'NO_EXACT_MATCH' when 'ONE' then 'EXACT_MATCH' else 'AMBIGUOUS_EXACT_MATCH' end exact_status, split_part(v, ' ', 2) exact_reason,
f.invoice_id, f.score confidence_score, case when f.score >= 90 then 'VERY_HIGH' when f.score >= 70 then 'HIGH' when f.score >= 40 then 'MEDIUM' when f.score > 0 then 'LOW' when f.score = 0 then 'NONE' end confidence_level
from xd left join final f on xd.payment_id = f.payment_id and f.rk = 1"""

# the same chain for the other matches, and all of it in one row per payment
_CHAIN_PAIRS = _IDENT.rstrip() + pairs(SQL, "(select i.customer_id from identified i where i.payment_id = j.payment_id) customer_id, false archived", 365, 30)[len(_J):]


def _chained(sql: str, prefix: str) -> str:
    return sql.replace(prefix, _CHAIN_PAIRS).replace("rn > 2", "rn > 30")


WHOLE = f"""select r.*, p.status partial_status, p.reason_code partial_reason, m.status multi_status, m.reason_code multi_reason, b.status combination_status, b.reason_code combination_reason
from ({RECONCILED}) r join ({_chained(PARTIAL, _TIGHT_ROUND)}) p on p.payment_id = r.payment_id join ({_chained(MULTI, _WIDE_ROUND)}) m on m.payment_id = r.payment_id
join ({_chained(COMBINATION, _WIDE_ROUND)}) b on b.payment_id = r.payment_id"""
PAYLOADS = f"select payment_id, invoice_id, exact_status, partial_reason, multi_reason, combination_status, confidence_level from ({WHOLE})"

# --- ledger ---------------------------------------------------------------------------------------

# five changes per payment, folded by hand: state (a, u) after each
_CH = f"""{ctes('payments')}, b as (select *, status <> 'IGNORED' and currency = 'INR' ok, cast(amount * 0.5 as decimal(14,2)) c1, cast(amount * 0.6 as decimal(14,2)) c2, cast(amount * 0.2 as decimal(14,2)) c3, currency = 'INR' inr,
  cast(allocated_amount as decimal(14,2)) a0, cast(unallocated_amount as decimal(14,2)) u0 from payments),
s1 as (select *, ok and c1 <= u0 t1, a0 + case when ok and c1 <= u0 then c1 else 0 end a1, u0 - case when ok and c1 <= u0 then c1 else 0 end u1 from b),
s2 as (select *, ok and c2 <= u1 t2, a1 + case when ok and c2 <= u1 then c2 else 0 end a2, u1 - case when ok and c2 <= u1 then c2 else 0 end u2 from s1),
s3 as (select *, inr and c3 <= a2 t3, a2 - case when inr and c3 <= a2 then c3 else 0 end a3, u2 + case when inr and c3 <= a2 then c3 else 0 end u3 from s2),
s5 as (select *, ok and c2 <= u3 t5, a3 + case when ok and c2 <= u3 then c2 else 0 end a5, u3 - case when ok and c2 <= u3 then c2 else 0 end u5 from s3)"""
_OFF = "case when status = 'IGNORED' then 'PAYMENT_IGNORED' when not inr then 'CURRENCY_MISMATCH'"
ALLOCATIONS = f"""{_CH} select payment_id, 1::bigint seq, {_OFF} when t1 then 'ACCEPTED' else 'EXCEEDS_UNALLOCATED' end verdict, cast(a1 as decimal(14,2)) allocated_after, cast(u1 as decimal(14,2)) unallocated_after from s5
union all select payment_id, 2, {_OFF} when t2 then 'ACCEPTED' else 'EXCEEDS_UNALLOCATED' end, cast(a2 as decimal(14,2)), cast(u2 as decimal(14,2)) from s5
union all select payment_id, 3, case when not inr then 'CURRENCY_MISMATCH' when t3 then 'ACCEPTED' else 'EXCEEDS_ALLOCATED' end, cast(a3 as decimal(14,2)), cast(u3 as decimal(14,2)) from s5
union all select payment_id, 4, case when status = 'IGNORED' then 'PAYMENT_IGNORED' else 'CURRENCY_MISMATCH' end, cast(a3 as decimal(14,2)), cast(u3 as decimal(14,2)) from s5
union all select payment_id, 5, {_OFF} when t5 then 'ACCEPTED' else 'EXCEEDS_UNALLOCATED' end, cast(a5 as decimal(14,2)), cast(u5 as decimal(14,2)) from s5"""
ALLOCATED = f"""{_CH} select payment_id, cast(a5 as decimal(14,2)) allocated_amount, cast(u5 as decimal(14,2)) unallocated_amount,
case when t5 then case when u5 = 0 then 'RECONCILED' else 'PARTIALLY_RECONCILED' end when t3 then case when a3 = 0 then 'UNRECONCILED' else 'PARTIALLY_RECONCILED' end
when t2 then case when u2 = 0 then 'RECONCILED' else 'PARTIALLY_RECONCILED' end when t1 then case when u1 = 0 then 'RECONCILED' else 'PARTIALLY_RECONCILED' end else status end status from s5"""
RECEIPTS = f"""{ctes('invoices')}, r as (select *, status in ('PENDING', 'PARTIALLY_PAID') ok, cast(outstanding_amount * 0.5 as decimal(14,2)) r1, cast(outstanding_amount * 0.75 as decimal(14,2)) r2 from invoices),
s1 as (select *, case when ok then r1 else 0 end p1 from r), s2 as (select *, case when ok and r2 > 0 and r2 <= outstanding_amount - p1 then r2 else 0 end p2 from s1),
s3 as (select *, case when ok and r1 <= outstanding_amount - p1 - p2 then r1 else 0 end p3 from s2)
select invoice_id, cast(paid_amount + p1 + p2 + p3 as decimal(14,2)) paid_amount, cast(outstanding_amount - p1 - p2 - p3 as decimal(14,2)) outstanding_amount,
case when not ok then status when outstanding_amount - p1 - p2 - p3 = 0 then 'PAID' else 'PARTIALLY_PAID' end status from s3"""
PAYMENT_CHANGES = f"""{ctes('payments')}, v as (select *, case when payment_id % 3 <> 0 then null when payment_id % 2 = 0 and payment_id % 5 = 0 then 'REASON_REQUIRED' when payment_id % 2 = 0 and allocated_amount <> 0 then 'HAS_ALLOCATIONS'
  when payment_id % 2 = 1 and status <> 'IGNORED' then 'NOT_IGNORED' else 'ACCEPTED' end cv from payments)
select payment_id, case when cv = 'ACCEPTED' then case when payment_id % 2 = 0 then 'IGNORED' else 'UNRECONCILED' end else status end status, cv change_verdict from v"""
INVOICE_CHANGES = f"""{ctes('invoices')}, v as (select *, invoice_id % 4 m, case when invoice_id % 5 = 0 then issue_date - 1 else issue_date + 60 end nd from invoices),
w as (select *, case when invoice_id % 3 <> 0 then null when m = 0 and status = 'PAID' then 'ALREADY_PAID' when m = 0 and paid_amount <> 0 then 'HAS_PAYMENTS' when m = 2 and nd < issue_date then 'DUE_BEFORE_ISSUE' else 'ACCEPTED' end cv from v)
select invoice_id, case when cv = 'ACCEPTED' and m = 0 then 'CANCELLED' else status end status, case when cv = 'ACCEPTED' and m = 1 then true when cv = 'ACCEPTED' and m = 3 then false else is_archived end is_archived,
case when cv = 'ACCEPTED' and m = 2 then nd else due_date end due_date, cv change_verdict from w"""
CUSTOMER_CHANGES = f"""{ctes('customers')} select customer_id, case when customer_id % 3 = 0 then customer_id % 2 = 0 else is_archived end is_archived, case when customer_id % 3 = 0 then 'ACCEPTED' end change_verdict from customers"""
LOAD_CUSTOMERS = f"""{ctes('customers')}, n as (select company_id, customer_id seq, regexp_replace(trim(case when customer_id % 10 = 0 then '  ' when customer_id % 7 = 0 then ' shared  name ' || customer_id % 3
  when customer_id % 2 = 0 then upper(name) else name || ' new' end), '\\s+', ' ', 'g') nm from customers),
f as (select *, min(seq) over (partition by company_id, lower(nm)) first_seq from n)
select seq, nm as name, case when nm = '' then 'NAME_REQUIRED' when exists (select 1 from customers c where c.company_id = f.company_id and lower(c.name) = lower(nm)) or first_seq <> seq then 'NAME_TAKEN' else 'ACCEPTED' end verdict from f"""
LOAD_IDENTIFIERS = f"""{ctes('customers', 'identifiers')}, n as (select company_id, customer_id seq, customer_id % 9 = 0 no_owner, case when customer_id % 8 = 0 then 'IBAN' else 'BANK_ACCOUNT' end ty,
  case when customer_id % 4 = 1 then cast(900000000 + customer_id as varchar) else 'X' || customer_id % 50 end val from customers),
f as (select *, case when no_owner then 'CUSTOMER_NOT_FOUND' when ty = 'IBAN' then 'UNKNOWN_TYPE' end early from n),
g as (select *, min(case when early is null then seq end) over (partition by company_id, ty, lower(val)) first_seq from f)
select seq, ty identifier_type, val identifier_value, coalesce(early, case when exists (select 1 from identifiers i where i.company_id = g.company_id and i.identifier_type = ty and lower(i.identifier_value) = lower(val))
or first_seq <> seq then 'IDENTIFIER_TAKEN' end, 'ACCEPTED') verdict from g"""
LOAD_ALIASES = f"""{ctes('customers', 'aliases')}, n as (select company_id, customer_id seq, case when customer_id % 6 = 0 then null when customer_id % 3 = 0 then regexp_replace(email, '@.*', '') || ' trading' else 'alias ' || customer_id % 40 end an from customers),
g as (select *, min(seq) over (partition by company_id, lower(an)) first_seq from n)
select seq, an alias_name, case when an is null then 'ALIAS_REQUIRED' when exists (select 1 from aliases a where a.company_id = g.company_id and lower(a.alias_name) = lower(an)) or first_seq <> seq then 'ALIAS_TAKEN' else 'ACCEPTED' end verdict from g"""
LOAD_PAYMENTS = f"""{ctes('payments')}, n as (select company_id, payment_id seq, case when payment_id % 9 = 0 then 0 else amount end amt, case when payment_id % 3 = 0 then 'R' || payment_id % 100 when payment_id % 3 = 1 then nullif(trim(payment_reference), '') end ref from payments),
g as (select *, min(case when amt > 0 then seq end) over (partition by company_id, ref) first_seq from n)
select seq, ref payment_reference, cast(amt as decimal(14,2)) unallocated_amount, case when amt <= 0 then 'NON_POSITIVE_AMOUNT' when ref is not null and (exists (select 1 from payments p where p.company_id = g.company_id and p.payment_reference = ref)
or first_seq <> seq) then 'REFERENCE_TAKEN' else 'ACCEPTED' end verdict from g"""
