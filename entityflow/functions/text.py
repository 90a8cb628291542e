"""Match keys as column expressions: e-mail, phone, name, company, domain; string similarities."""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Free-mail domains, company suffixes, role addresses.
FREEMAIL_DOMAINS = (
    "gmail.com", "googlemail.com", "yahoo.com", "hotmail.com", "outlook.com", "live.com", "aol.com", "icloud.com",
    "me.com", "protonmail.com", "gmx.de", "mail.com", "yandex.ru", "qq.com", "163.com",
)
COMPANY_SUFFIXES = (
    "inc", "incorporated", "llc", "ltd", "limited", "plc", "corp", "corporation", "co", "company", "gmbh", "ag", "sa",
    "nv", "bv", "ab", "as", "oy", "kk", "pty", "pte", "srl", "spa", "sas", "holdings", "group", "the",
)
ROLE_LOCAL_PARTS = (
    "info", "sales", "support", "admin", "contact", "hello", "help", "billing", "accounts", "office", "team",
    "marketing", "press", "careers", "jobs", "noreply", "no-reply", "webmaster", "postmaster", "enquiries", "inquiries",
)


# Nicknames and the formal name that each stands for.
NICKNAMES = {
    "bill": "william", "will": "william", "billy": "william", "bob": "robert", "rob": "robert", "bobby": "robert",
    "dick": "richard", "rick": "richard", "ricky": "richard", "jim": "james", "jimmy": "james", "jamie": "james",
    "joe": "joseph", "joey": "joseph", "mike": "michael", "mick": "michael", "dave": "david", "steve": "stephen",
    "steven": "stephen", "tom": "thomas", "tommy": "thomas", "tony": "anthony", "chris": "christopher", "dan": "daniel",
    "danny": "daniel", "matt": "matthew", "nick": "nicholas", "kate": "katherine", "katie": "katherine",
    "kathy": "katherine", "liz": "elizabeth", "beth": "elizabeth", "betty": "elizabeth", "sue": "susan", "suzy": "susan",
    "peggy": "margaret", "maggie": "margaret", "jenny": "jennifer", "jen": "jennifer",
}


def fold(s: str) -> str:
    return s if s.isascii() else "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))


def _arrow(f, kind: str):
    """An Arrow UDF of a function of strings; null stays null, and equal values of a batch are computed once."""
    arrow = {"string": pa.string(), "double": pa.float64(), "array<string>": pa.list_(pa.string())}[kind]

    def one(a: pa.Array) -> pa.Array:
        known = {None: None}
        values = a.to_pylist()
        for v in values:
            if v not in known:
                known[v] = f(v)
        return pa.array([known[v] for v in values], arrow)

    one.__annotations__ = {"a": pa.Array, "return": pa.Array}
    return F.arrow_udf(one, kind)


def strip_accents(text: Column) -> Column:
    """Compatibility form without combining marks; ASCII text never reaches Python's tables."""
    return _arrow(fold, "string")(text)


def _stripped(raw: Column) -> Column:
    return F.regexp_replace(raw, r"^\s+|\s+$", "")


def normalize_email(raw: Column) -> Column:
    """Lower case, no accents; ``+tag`` dropped; dots of the local part dropped for Gmail alone; no ``@``: as it is."""
    mail = strip_accents(F.lower(_stripped(raw)))
    domain = F.regexp_replace(F.regexp_extract(mail, r"@([^@]*)$", 1), r"^\.+|\.+$", "")
    local = F.regexp_replace(F.regexp_extract(mail, r"^(.*)@[^@]*$", 1), r"\+.*$", "")
    gmail = domain.isin("gmail.com", "googlemail.com")
    local = F.when(gmail, F.replace(local, F.lit("."), F.lit(""))).otherwise(local)
    domain = F.when(gmail, F.lit("gmail.com")).otherwise(domain)
    whole = F.when((local != "") & (domain != ""), F.concat(local, F.lit("@"), domain))
    return F.when(mail == "", None).when(~mail.contains("@"), mail).otherwise(whole)


def email_domain(mail: Column) -> Column:
    return F.when(mail.contains("@"), F.regexp_extract(mail, r"@([^@]*)$", 1))


def is_freemail(mail: Column) -> Column:
    return F.coalesce(email_domain(mail).isin(*FREEMAIL_DOMAINS), F.lit(False))


def normalize_phone(raw: Column, country: str = "1") -> Column:
    """E.164, or null where the number is too short or too long; an extension is cut off."""
    raw = _stripped(raw)
    digits = lambda c: F.regexp_replace(c, r"[^0-9]", "")
    abroad = raw.startswith("+") | raw.startswith("00")
    main = F.when(raw.startswith("00"), F.substr(digits(raw), F.lit(3))).otherwise(digits(raw))
    # What stands before an extension keeps a leading 00.
    cut = digits(F.regexp_replace(raw, r"(?is)(?:ext|x|extension)\.?.*$", ""))
    number = F.when(raw.rlike(r"(?i)(?:ext|x|extension)\.?\s*\d+$"), cut).otherwise(main)
    size = F.length(number)
    home = F.when(~abroad & (size == 10), F.concat(F.lit("+" + country), number))
    return F.when(main != "", F.coalesce(home, F.when(size.between(8, 15), F.concat(F.lit("+"), number))))


def normalize_name(raw: Column) -> Column:
    """Lower-case letters a-z and digits, accents folded, all else a space; nothing left: null."""
    text = F.regexp_replace(strip_accents(F.lower(raw)), r"['`]", "")
    return F.nullif(F.trim(F.regexp_replace(text, r"[^a-z0-9]+", " ")), F.lit(""))


def canonical_first_name(raw: Column) -> Column:
    """The first word of a name, a nickname replaced by its formal name."""
    head = F.split_part(normalize_name(raw), F.lit(" "), F.lit(1))
    names = F.create_map(*[F.lit(x) for pair in NICKNAMES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, head), head)


def normalize_company(raw: Column) -> Column:
    """Name without legal suffixes at its end and ``the`` at its start; a name of suffixes alone stays."""
    name = normalize_name(raw)
    short = F.trim(F.regexp_replace(name, r"(?:(?:^| )(?:" + "|".join(COMPANY_SUFFIXES) + r"))+$", ""))
    short = F.regexp_replace(short, r"^(?:the(?: |$))+", "")
    return F.when(short == "", name).otherwise(short)


def normalize_domain(raw: Column) -> Column:
    """Host of a URL or bare domain without ``www.``; nothing left: null."""
    text = F.regexp_replace(F.lower(_stripped(raw)), r"^[a-z]+://", "")
    text = F.regexp_replace(F.regexp_replace(text, r"(?s)[/?].*$", ""), r"^www\.", "")
    return F.nullif(F.regexp_replace(text, r"^\.+|\.+$", ""), F.lit(""))


def levenshtein_ratio(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1.0 - F.levenshtein(a, b) / longest)


def token_set_ratio(a: Column, b: Column) -> Column:
    x, y = (F.filter(F.array_distinct(F.split(c, r"\s+")), lambda w: w != "") for c in (a, b))
    both = F.size(F.array_union(x, y))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.size(F.array_intersect(x, y)) / both)


def jaro(a: str, b: str) -> float:
    if a == b:
        return 1.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    used = [False] * len(b)
    found = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                found.append(c)
                break
    if not found:
        return 0.0
    other = [c for c, u in zip(b, used, strict=True) if u]
    swapped = sum(x != y for x, y in zip(found, other, strict=True)) // 2
    m = len(found)
    return (m / len(a) + m / len(b) + (m - swapped) / m) / 3


def _jaro_winkler(a: pa.Array, b: pa.Array) -> pa.Array:
    known: dict[tuple, float | None] = {}  # equal pairs of a batch are compared once
    out = []
    for pair in zip(a.to_pylist(), b.to_pylist(), strict=True):
        if pair not in known:
            known[pair] = None if None in pair else boosted_jaro(*pair)
        out.append(known[pair])
    return pa.array(out, pa.float64())


def boosted_jaro(x: str, y: str) -> float:
    j = jaro(x, y)
    same = next((k for k in range(min(4, len(x), len(y))) if x[k] != y[k]), min(4, len(x), len(y)))
    return j + 0.1 * same * (1 - j) if j >= 0.7 else j


_jaro_winkler.__annotations__ = {"a": pa.Array, "b": pa.Array, "return": pa.Array}


def jaro_winkler(a: Column, b: Column) -> Column:
    """Jaro with 0.1 for each common first letter (four at most) where Jaro is 0.7 or more."""
    return F.arrow_udf(_jaro_winkler, "double")(a, b)


def normalize_linkedin(raw: Column) -> Column:
    """The profile's slug, or else the whole text in lower case; empty: null."""
    low = F.regexp_replace(F.lower(_stripped(raw)), r"/+$", "")
    slug = F.regexp_extract(low, r"linkedin\.com/(?:in|pub)/([^/?#]+)", 1)
    return F.coalesce(F.nullif(slug, F.lit("")), F.nullif(low, F.lit("")))


def is_initial_of(short: Column, long: Column) -> Column:
    return F.coalesce((F.length(short) == 1) & long.startswith(short), F.lit(False))


def hash_value(value: Column) -> Column:
    """32 hex digits of the SHA-256 of a value's JSON."""
    quoted = F.regexp_replace(F.regexp_replace(value.cast("string"), r"\\", r"\\\\"), '"', r'\\"')
    return F.substring(F.sha2(F.coalesce(F.concat(F.lit('"'), quoted, F.lit('"')), F.lit("null")), 256), 1, 32)


# Phonetic codes: of a letter's rules the first that matches at the place holds; what it matches is consumed.
# (pattern, primary, secondary or None for the same); None for both: silent. Fixed values, as the codes must agree.
_VOWEL = "[AEIOUY]"
_PHONETIC = {
    "B": [("BB?", "P", None)],
    "C": [
        ("CH(?=IA)", "K", None), (r"\ACH(?=ARAC|ARIS)", "K", None), ("CH(?=ORE|YMO|AE|AO|UR)", "K", None), ("CH", "X", "K"),
        ("CZ", "S", "X"), ("CIA", "X", None), ("C[IEY]", "S", None), ("CK", "K", None), ("CC(?![IEY])", "K", None), ("C", "K", None),
    ],
    "D": [("DG[IEY]", "J", None), ("DG", "TK", None), ("D[TD]?", "T", None)],
    "F": [("FF?", "F", None)],
    "G": [
        (r"(?:\A|(?<=[^AEIOUY]))GH", "K", None), ("GH", None, None), (r"\AGN", "KN", "N"), ("GN", "N", "KN"),
        ("G[IEY]", "J", "K"), ("GG?", "K", None),
    ],
    "H": [(rf"(?:\A|(?<={_VOWEL}))H(?={_VOWEL})", "H", None), ("H", None, None)],
    "J": [("J(?=OSE)", "H", None), (r"\AJJ?", "J", "A"), ("JJ?", "J", "H")],
    "K": [("KK?", "K", None)],
    "L": [("LL?", "L", None)],
    "M": [("MM?", "M", None)],
    "N": [("NN?", "N", None)],
    "P": [("PH", "F", None), ("P[PB]?", "P", None)],
    "Q": [("QQ?", "K", None)],
    "R": [("RR?", "R", None)],
    "S": [("SCH(?=ER|EN|UY|ED|EM)", "X", "SK"), ("SCH", "X", None), ("SH", "X", None), ("S[IY]", "S", None), ("S[SZ]?", "S", None)],
    "T": [("TI[AO]", "X", None), ("TH", "0", "T"), ("T(?=C)", None, None), ("TT?", "T", None)],
    "V": [("VV?", "F", None)],
    "W": [("WR", "R", None), (rf"\AW(?={_VOWEL})", "A", "F"), (r"\AW(?=H)", "A", None), (rf"(?<={_VOWEL})W", "F", None), ("W", None, None)],
    "X": [("X[CX]?", "KS", None)],
    "Z": [("ZH", "J", None), ("ZZ?", "S", "TS")],
}
_PHONETIC = {letter: [(re.compile(p), one, two) for p, one, two in rules] for letter, rules in _PHONETIC.items()}
#: In names with these letters GN is Slavic or Germanic anywhere.
_SLAVIC = re.compile("W|K|CZ")
_CODE = 4


def metaphone(name: str) -> list[str]:
    """[primary, secondary] phonetic code of a name, four characters at most; both empty without a letter."""
    text = re.sub("[^A-Z]", "", fold(name).upper())
    at = 1 if text[:2] in ("GN", "KN", "PN", "WR", "PS") or text[:1] == "X" else 0
    parts = [("S", "S")] if text[:1] == "X" else []
    slavic = bool(_SLAVIC.search(text))
    while at < len(text) and len(parts) < _CODE:
        if text[at] in "AEIOUY":
            if at == 0:
                parts.append(("A", "A"))
            at += 1
            continue
        found, one, two = next((m, x, y) for rule, x, y in _PHONETIC[text[at]] if (m := rule.match(text, at)))
        if slavic and found[0] == "GN":
            one, two = "KN", "N"
        if one:
            parts.append((one, two or one))
        at = found.end()
    return ["".join(p[k] for p in parts)[:_CODE] for k in (0, 1)]


def double_metaphone(name: Column) -> Column:
    """array(primary, secondary) of a name."""
    return _arrow(metaphone, "array<string>")(F.coalesce(name, F.lit("")))


def dm_primary(name: Column) -> Column:
    return double_metaphone(name)[0]


def dm_codes(name: Column) -> Column:
    """The distinct codes of a name that are not empty."""
    return F.filter(F.array_distinct(double_metaphone(name)), lambda c: c != "")


def phonetically_equal(a: Column, b: Column) -> Column:
    return F.arrays_overlap(dm_codes(a), dm_codes(b))


#: The keys that matching derives from a raw record, and the raw columns they are made of.
RAW_COLUMNS = (
    "email", "phone", "first_name", "last_name", "company", "company_name", "name", "domain", "website", "linkedin",
    "linkedin_url", "job_title", "title", "external_id", "phone_verified",
)


def normalize_record(records: DataFrame, *, country: str = "1") -> DataFrame:
    """``records`` with every key that matching needs; raw columns that are absent count as null.

    Keys: email, email_domain, email_is_freemail, first_name, first_name_canonical, last_name, first_initial,
    first_name_dm, last_name_dm, normalized_company, company_dm, domain, phone_e164, linkedin, job_title, external_id, phone_verified. Applying it to its
    own result changes nothing.
    """
    held = {c.lower() for c in records.columns}
    raw = {c: F.col(c) if c in held else F.lit(None).cast("string") for c in RAW_COLUMNS}
    some = lambda *names: F.coalesce(*[F.nullif(raw[n].cast("string"), F.lit("")) for n in names])
    # Python's results are made once, by a projection of their own, and read by name after it.
    found = records.withColumns(
        {
            "_email": normalize_email(raw["email"]),
            "_first": normalize_name(raw["first_name"]),
            "_last": normalize_name(raw["last_name"]),
            "normalized_company": normalize_company(some("company", "company_name", "name") if "normalized_company" not in held else F.col("normalized_company")),
            "_title": normalize_name(some("job_title", "title")),
        }
    )
    domain = email_domain(F.col("_email"))
    found = found.withColumns(
        {
            "email": F.col("_email"),
            "email_domain": domain,
            "email_is_freemail": is_freemail(F.col("_email")),
            "first_name_canonical": canonical_first_name(F.col("_first")),
            "first_initial": F.nullif(F.substring("_first", 1, 1), F.lit("")),
            "first_name_dm": dm_primary(F.col("_first")),
            "last_name_dm": dm_primary(F.col("_last")),
            "company_dm": dm_primary(F.col("normalized_company")),
            "domain": F.coalesce(normalize_domain(some("domain", "website")), F.when(~is_freemail(F.col("_email")), domain)),
            "phone_e164": normalize_phone(raw["phone"], country),
            "linkedin": normalize_linkedin(some("linkedin", "linkedin_url")),
            "job_title": F.col("_title"),
            "external_id": raw["external_id"],
            "phone_verified": F.coalesce(raw["phone_verified"].cast("boolean"), F.lit(False)),
        }
    )
    return found.withColumns({"first_name": F.col("_first"), "last_name": F.col("_last")}).drop("_email", "_first", "_last", "_title")
