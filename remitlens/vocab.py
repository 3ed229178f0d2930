"""Word lists, codes and patterns that decide results.

They have to equal the values of the rules they implement, so they are stated here as plain text.
"""

# --- payer text -------------------------------------------------------------------------------

# Words that never identify a customer.
BANKING_STOPWORDS = (
    # rails and transfer types
    "neft rtgs imps upi ach nach ecs pos atm cms ift tfr trf clg chq cheque dd wire swift ft "
    "funds transfer remittance settlement "
    # transaction words
    "payment pyd pymt pay received rcvd credit cr deposit dep debit dr withdrawal wdl refund "
    "chargeback fee charges interest tax gst tds cash online auto mandate drfee crfee "
    # bank names and generic bank words
    "bank bnk sbi hdfc icici axis pnb bob kotak yes idbi canara union indusind rbi branch acc "
    "acct account no num ref reference utr urn id txn trans transaction bill inv invoice to by "
    "from for in on at via through with "
    # aggregators and gateways
    "rzp razorpay paytm phonepe gpay googlepay bharatpe cashfree billdesk ccavenue pinelabs "
    "instamojo stripe payu"
).split()

# Legal-form endings; at most one is cut from the end of a name, two-word forms first.
LEGAL_SUFFIXES = [
    "pvt ltd", "p ltd", "private ltd", "pvt limited", "private limited",
    "ltd", "limited", "inc", "incorporated", "corp", "corporation", "llc", "llp", "gmbh", "sa",
    "co", "company",
]

# Tax ids that mean "none"; compared in upper case after separators are dropped.
TAX_ID_PLACEHOLDERS = ["NA", "NONE", "PENDING", "NULL", "N/A", "NIL", "NOTAPPLICABLE"]

# Controls that are removed (not turned into spaces): NUL and the bidi marks.
CONTROL_CHARS = r"[\x00\u200e\u200f\u202a-\u202e\u2066-\u2069]"

VPA_PATTERN = r"(?U)\b[a-zA-Z0-9.\-_]{2,64}@[a-zA-Z0-9.\-_]{2,32}\b"
ACCOUNT_PATTERN = r"(?U)\b[0-9]{9,18}\b"
RAIL_PREFIX = r"(?i)^(?:upi|neft|imps|rtgs|cr|dr|clg|ift|tfr|trf)[-_/]+(?:[0-9]+[-_/]+)?"

# --- invoice references -----------------------------------------------------------------------

REFERENCE_TOKEN = r"(?U)\b[A-Za-z0-9][A-Za-z0-9\-_/]{2,}\b"
REFERENCE_PREFIX = r"(?i)^(INV|BILL|INVOICE)[-_/:]?"
EVIDENCE_UTR = r"(?iU)\b[A-Z0-9]{12,22}\b"
EVIDENCE_INVOICE = r"(?iU)\b(?:INV|BILL|REC)[-_A-Z0-9]{3,30}\b"

# --- statement files --------------------------------------------------------------------------

DELIMITERS = [",", "\t", ";", "|"]
HEADER_DATE_WORDS = ["date"]
HEADER_TEXT_WORDS = ["narration", "desc", "particular", "remark", "detail"]
HEADER_AMOUNT_WORDS = ["credit", "debit", "amount", "deposit", "withdrawal", "balance"]

# Canonical column -> header words, tried in this order.
HEADER_TAXONOMY = {
    "type_indicator": ["dr/cr", "cr/dr", "txn type", "transaction type", "type", "d/c"],
    "transaction_date": ["txn date", "transaction date", "trans date", "booking date",
                         "posting date", "date"],
    "value_date": ["value date", "val date", "effective date"],
    "narration": ["narration", "particular", "description", "remark", "detail", "memo"],
    "reference_number": ["ref no", "reference no", "reference", "utr", "chq", "cheque",
                         "journal", "txn id"],
    "credit": ["credit", "deposit", "cr amount", "cr"],
    "debit": ["debit", "withdrawal", "dr amount", "dr"],
    "amount": ["txn amount", "transaction amount", "net amount", "amount"],
    "balance": ["running bal", "closing bal", "balance", "bal"],
    "currency": ["currency", "ccy", "curr"],
    "counterparty": ["counterparty", "beneficiary", "payee", "party name"],
}

# Day-first forms before the US form. One- and two-digit days and months are both taken.
STATEMENT_DATE_FORMATS = [
    ("^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$", "yyyy-M-d"),
    ("^[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}$", "d-M-yyyy"),
    ("^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$", "d/M/yyyy"),
    (r"^[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}$", "d.M.yyyy"),
    ("^[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}$", "yyyy/M/d"),
    ("^[0-9]{1,2}-[A-Za-z]{3}-[0-9]{4}$", "d-MMM-yyyy"),
    ("^[0-9]{1,2}-[A-Za-z]{3,9}-[0-9]{4}$", "d-MMMM-yyyy"),
    ("^[A-Za-z]{3} [0-9]{1,2}, [0-9]{4}$", "MMM d, yyyy"),
    ("^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$", "M/d/yyyy"),
]

UTR_PATTERNS = [
    r"(?U)\b([A-Z]{4}[0-9]{10,16})\b",
    r"(?iU)\b(?:UPI|IMPS|NEFT|RTGS)[/:_-]([A-Z0-9]{10,22})\b",
    r"(?iU)\bUTR[:\s-]*([A-Z0-9]{10,22})\b",
    r"(?iU)\bREF[:\s-]*([A-Z0-9]{8,22})\b",
]

FORMULA_PREFIX = "^[=+\\-@\\t\\r]"
CREDIT_WORDS = ["CR", "CREDIT", "DEPOSIT", "+", "C"]
DEBIT_WORDS = ["DR", "DEBIT", "WITHDRAWAL", "-", "D"]
REFERENCE_PLACEHOLDERS = ["NA", "N/A", "NONE", "0", "-", ".", "NULL", "N.A.", "NOTAVAILABLE"]
STATEMENT_EXTENSIONS = [".csv", ".txt"]

# --- documents --------------------------------------------------------------------------------

MIN_DOCUMENT_BYTES = 8
MIME_EXTENSIONS = {
    "application/pdf": [".pdf"],
    "image/png": [".png"],
    "image/jpeg": [".jpg", ".jpeg"],
}

INDIAN_GROUPING = r"^(?:[0-9]{1,2}(?:,[0-9]{2})+|[0-9]{1,3}),[0-9]{3}(?:\.[0-9]{1,2})?$"
WESTERN_GROUPING = r"^[0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]{1,2})?$"

# Symbol or code -> currency, first hit in this order.
CURRENCY_SYMBOLS = [
    ("₹", "INR"), ("rs", "INR"), ("rs.", "INR"), ("inr", "INR"), ("$", "USD"), ("usd", "USD"),
    ("€", "EUR"), ("eur", "EUR"), ("£", "GBP"), ("gbp", "GBP"),
]

MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september",
          "october", "november", "december"]

GSTIN = r"(?U)\b([0-9]{2}[A-Z]{5}[0-9]{4}[A-Z]{1}[1-9A-Z]{1}Z[0-9A-Z]{1})\b"
PAN = r"(?U)\b([A-Z]{5}[0-9]{4}[A-Z]{1})\b"
VAT = r"(?U)\b((?:GB|DE|FR|IT|ES)[0-9A-Z]{8,12})\b"
PO_NUMBER = (r"(?iU)\b(?:P\.?O\.?\s*(?:No\.?|Num\.?|Number|#)?|Purchase\s*Order\s*(?:No\.?|Num\.?|#)?)"
             r"\s*[:#]?\s*([A-Za-z0-9\-_/]{3,30})\b")
PAYMENT_REF = (r"(?iU)\b(?:UTR\s*(?:No\.?|#)?|Payment\s*Ref\s*(?:No\.?|#)?|Transaction\s*(?:ID|Ref|No\.?))"
               r"\s*[:#]?\s*([A-Za-z0-9]{8,22})\b")
INVOICE_LABELLED = (r"(?iU)\b(?:invoice\s*(?:number|num\.?|no\.?|#)?|tax\s*invoice\s*(?:number|num\.?|no\.?|#)?"
                    r"|bill\s*(?:number|num\.?|no\.?|#)?|inv)\s*[:#]\s*([A-Za-z0-9\-_/]{3,35})\b")
INVOICE_FALLBACK = r"(?iU)\b(INV[/-][A-Za-z0-9\-_/]{3,25})\b"
NOT_INVOICE_NUMBERS = [
    "NUMBER", "DATE", "AMOUNT", "TOTAL", "CLIENT", "CUSTOMER", "DRAFT", "ORIGINAL", "DUPLICATE",
    "TRIPLICATE", "TAX", "INVOICE", "CASH", "MEMO", "BILL", "PAGE", "COPY", "SUBTOTAL", "BALANCE",
]

CUSTOMER_LABEL = r"(?iU)(?:bill\s*to|customer|client|buyer|m/s|sold\s*to)[:\s-]*([^\n\r,;]{3,60})"
DOCUMENT_DATES = (r"(?U)\b(?:[0-9]{4}[-/][0-9]{2}[-/][0-9]{2}|[0-9]{1,2}[-/][0-9]{1,2}[-/][0-9]{2,4}"
                  r"|[0-9]{1,2}\s+[A-Za-z]{3,9}\s+[0-9]{4})\b")
AMOUNT_AFTER_LABEL = (r"[:\s]*((?:INR|USD|EUR|GBP|[₹$€£])?[:\s]*[0-9][0-9,]*\.[0-9]{2}"
                      r"|(?:INR|USD|EUR|GBP|[₹$€£])?[:\s]*[0-9][0-9,]*)")
TOTAL_LABEL = r"(?iU)\b(?:grand\s*total|net\s*amount|total\s*amount|amount\s*due|total)\b" + AMOUNT_AFTER_LABEL
SUBTOTAL_LABEL = r"(?iU)\b(?:sub\s*total|taxable\s*amount|taxable\s*value)\b" + AMOUNT_AFTER_LABEL
TAX_LABEL = r"(?iU)\b(?:tax\s*amount|total\s*tax|gst\s*amount|cgst\s*\+\s*sgst|igst)\b" + AMOUNT_AFTER_LABEL

# --- evidence ---------------------------------------------------------------------------------

EVIDENCE_TYPES = [
    "BANK_ACCOUNT_IDENTIFIER", "UPI_VPA_IDENTIFIER", "CUSTOMER_NAME_TOKEN", "CUSTOMER_ALIAS",
    "CUSTOMER_TAX_ID", "PAYMENT_REFERENCE", "UTR_IDENTIFIER", "INVOICE_NUMBER_IN_NARRATION",
    "AMOUNT_EXACT_EQUALITY", "AMOUNT_PARTIAL_COMPATIBLE", "AMOUNT_OVERPAYMENT",
    "COMBINATION_SUM_EQUALITY", "DATE_CAUSALITY", "DATE_PROXIMITY", "CURRENCY_CONSISTENCY",
    "HISTORICAL_CUSTOMER_PATTERN", "PURCHASE_ORDER_REFERENCE",
]

EVIDENCE_SOURCES = [
    "payment.bank_account_number", "payment.payer_raw_identifier", "payment.narration",
    "payment.payment_reference", "payment.payment_date", "payment.currency", "payment.amount",
    "customer.name", "customer.tax_id", "customer.identifiers", "customer.aliases",
    "invoice.invoice_number", "invoice.outstanding_amount", "invoice.issue_date",
    "invoice.due_date", "invoice.currency", "candidate.outstanding_amount", "candidate.currency",
    "candidate.due_date", "combination.subset",
]

# Observed result -> canonical result.
EVIDENCE_RESULTS = {
    "MATCHED": "MATCH", "EXACT_MATCH": "MATCH", "CONSISTENT": "MATCH",
    "PRESENT": "PRESENT", "EXTRACTED": "PRESENT",
    "TOKEN_OVERLAP": "SUPPORTED", "PARTIAL_AMOUNT": "SUPPORTED", "OVERPAYMENT_AMOUNT": "SUPPORTED",
    "CAUSAL": "SUPPORTED", "PROXIMATE": "SUPPORTED",
    "CONFLICT": "CONFLICT", "NON_CAUSAL": "CONFLICT",
    "ABSENT": "ABSENT", "DISTANT": "ABSENT", "UNREGISTERED": "ABSENT",
    "NO_MATCH": "NO_MATCH",
}

EVIDENCE_TARGETS = ["PAYMENT", "CUSTOMER", "INVOICE", "COMBINATION"]
EXACT_STRENGTH_TYPES = ["AMOUNT_EXACT_EQUALITY", "BANK_ACCOUNT_IDENTIFIER",
                        "INVOICE_NUMBER_IN_NARRATION", "COMBINATION_SUM_EQUALITY"]
MEDIUM_STRENGTH_TYPES = ["UTR_IDENTIFIER", "CUSTOMER_ALIAS", "AMOUNT_PARTIAL_COMPATIBLE",
                         "CURRENCY_CONSISTENCY", "DATE_CAUSALITY"]

IDENTIFIER_TYPES = ["BANK_ACCOUNT", "VIRTUAL_ACCOUNT", "UPI_VPA"]
OPEN_STATUSES = ["PENDING", "PARTIALLY_PAID"]
