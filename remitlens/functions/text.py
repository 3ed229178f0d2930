"""Payer text: cleaning, legal names, tokens, identifiers, VPAs, accounts, invoice tokens."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from remitlens import vocab


def blank_to_null(c: Column) -> Column:
    """NULL for NULL and for the empty string."""
    return F.nullif(c, F.lit(""))


def present(c: Column) -> Column:
    """True when the text holds something besides white space."""
    return F.coalesce(F.trim(c) != "", F.lit(False))


@lru_cache(maxsize=1)
def _compatibility_folds() -> tuple[str, str, list[tuple[str, str]]]:
    """Compatibility decomposition (NFKD) restricted to what can matter.

    Everything outside ASCII letters, digits, ``&`` and ``@`` ends up as a space, so only the
    characters whose decomposition holds one of those are needed. Built from the Unicode tables:
    one-to-one folds as a ``translate`` pair, the rest as (character, expansion) pairs.
    """
    source, target, longer = [], [], []
    for point in range(0x80, 0x110000):
        if 0xD800 <= point <= 0xDFFF:
            continue
        char = chr(point)
        folded = unicodedata.normalize("NFKD", char)
        if folded == char:
            continue
        folded = "".join(c for c in folded if unicodedata.category(c) != "Mn")
        if not any(c.isascii() and (c.isalnum() or c in "&@") for c in folded):
            continue
        if len(folded) == 1:
            source.append(char)
            target.append(folded)
        else:
            longer.append((char, folded))
    return "".join(source), "".join(target), longer


def fold_accents(c: Column) -> Column:
    """Compatibility-decompose and drop the marks; plain ASCII text passes through untouched."""
    source, target, longer = _compatibility_folds()
    single = F.regexp_replace(F.translate(c, source, target), r"\p{Mn}", "")
    # one literal "character + expansion" list: keeps the expression small
    pairs = F.split(F.lit("|".join(a + b for a, b in longer)), "[|]")
    expanded = F.aggregate(pairs, single, lambda text, p: F.replace(text, F.left(p, F.lit(1)), F.substring(p, 2, 20)))
    has_longer = F.translate(single, "".join(a for a, _ in longer), "") != single
    return (
        F.when(~c.rlike(r"[^\x00-\x7F]"), c)
        .when(has_longer, expanded)
        .otherwise(single)
    )


def clean_text(c: Column) -> Column:
    """Lower-case ASCII words separated by single spaces; never NULL."""
    text = fold_accents(F.coalesce(c, F.lit("")))
    text = F.regexp_replace(text, vocab.CONTROL_CHARS, "")
    text = F.replace(F.replace(text, F.lit("&"), F.lit(" and ")), F.lit("@"), F.lit(" at "))
    return F.array_join(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0), " ")


def strip_legal_suffix(cleaned: Column) -> Column:
    """Cut one legal ending from cleaned text; a name that is only an ending is kept."""
    return F.regexp_replace(cleaned, f"^(.+?) (?:{'|'.join(vocab.LEGAL_SUFFIXES)})$", "$1")


def legal_name(c: Column) -> Column:
    return strip_legal_suffix(clean_text(c))


def _stopwords() -> Column:
    return F.split(F.lit(" ".join(vocab.BANKING_STOPWORDS)), " ")


def tokens_of(cleaned: Column, min_length: int = 3) -> Column:
    """Distinct identifying words of cleaned text."""
    words = F.array_except(F.split(cleaned, " "), _stopwords())
    return F.filter(words, lambda w: (F.length(w) >= min_length) & (F.translate(w, "0123456789", "") != ""))


def tokens(c: Column, min_length: int = 3) -> Column:
    return tokens_of(clean_text(c), min_length)


def normalize_identifier(c: Column) -> Column:
    """Comparable form of an account number or VPA; never NULL."""
    text = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), vocab.CONTROL_CHARS, ""))
    kept = lambda part: F.lower(F.array_join(F.regexp_extract_all(part, F.lit("[a-zA-Z0-9._-]+"), 0), ""))
    user, handle = kept(F.substring_index(text, "@", 1)), kept(F.regexp_replace(text, "^[^@]*@", ""))
    plain = F.lower(F.regexp_replace(text, r"(?U)[\s\-_/.]", ""))
    return F.when(text.contains("@"), F.concat(user, F.lit("@"), handle)).otherwise(plain)


def extract_vpas(c: Column) -> Column:
    """VPAs in free text, rail prefixes stripped; the raw form is kept next to the stripped one."""
    stop = _stopwords()

    def forms(match: Column) -> Column:
        raw = F.lower(match)
        user = F.substring_index(raw, "@", 1)
        handle = F.substring_index(raw, "@", -1)
        stripped = F.regexp_replace(user, vocab.RAIL_PREFIX, "")
        vpa = F.concat(stripped, F.lit("@"), handle)
        return F.array(
            F.when((stripped != "") & ~F.array_contains(stop, stripped), vpa),
            F.when((raw != vpa) & ~F.array_contains(stop, user), raw),
        )

    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(vocab.VPA_PATTERN), 0)
    return F.array_distinct(F.array_compact(F.flatten(F.transform(found, forms))))


def extract_accounts(c: Column) -> Column:
    """Runs of 9 to 18 digits standing alone."""
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(vocab.ACCOUNT_PATTERN), 0)


def normalize_invoice_token(c: Column) -> Column:
    """Invoice number without its usual prefix and separators, upper case."""
    text = F.regexp_replace(F.trim(c), vocab.REFERENCE_PREFIX, "")
    return F.upper(F.trim(F.translate(text, "-_/:", "")))


def reference_tokens(text_upper: Column) -> Column:
    """Words of a payment text that may be invoice numbers, in order."""
    return F.regexp_extract_all(F.coalesce(text_upper, F.lit("")), F.lit(vocab.REFERENCE_TOKEN), 0)


def reference_keys(tokens_upper: Column) -> Column:
    """Every ``form`` under which one of ``tokens_upper`` can equal a normalised invoice number, with the ``token``, in order of the tokens."""
    forms = F.transform(tokens_upper, lambda t: F.array(
        F.struct(normalize_invoice_token(t).alias("form"), t.alias("token")), F.struct(t.alias("form"), t.alias("token"))))
    return F.array_distinct(F.flatten(F.filter(forms, lambda f: F.element_at(f, 1)["form"] != "")))


def evidence_invoice_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(vocab.EVIDENCE_INVOICE), 0)


def evidence_utr(c: Column) -> Column:
    """First UTR-shaped word, or NULL."""
    return blank_to_null(F.regexp_extract(F.coalesce(c, F.lit("")), vocab.EVIDENCE_UTR, 0))


def alphanumeric_upper(c: Column) -> Column:
    return F.upper(F.regexp_replace(F.coalesce(c, F.lit("")), "[^A-Za-z0-9]", ""))


def squeeze(c: Column) -> Column:
    """Trim and collapse white space."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))
