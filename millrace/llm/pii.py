"""Format-preserving pseudonyms for personal data, in SQL functions only.

Validated numbers and dates are permuted by a keyed Feistel network over their
own domain, so a pseudonym has the format of its value and equal values get
equal pseudonyms in all documents.  The network works on pairs (l, r) of
Z_a x Z_b, adding a keyed hash of one half to the other modulo its size; this is
a permutation whatever a and b are, so no value has to be tried again.

kind   validated by                       domain
card   13 to 19 digits, Luhn sum          all digits but the last; that one is recomputed
phone  grouping of digits                 the digits after the country code
ssn    area, group and serial in range    898 * 99 x 9999
ipv4   octets up to 255                   2^16 x 2^16
date   a day of the years 1800 to 2199    189 x 773 days; read and written in the same format
iban   remainder 1 modulo 97              account characters by class; check digits recomputed
email  syntax                             letters and digits of the local part by class
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROUNDS = 8
#: The session's setting that holds the secret key.
KEY_SETTING = "spark.millrace.pii.key"
_drawn: dict[str, str] = {}


def secret_key(spark: SparkSession) -> str:
    """The key that the session sets, else one drawn at random for the application.

    Only with a key of its own does a user get equal pseudonyms in another application.
    """
    return spark.conf.get(KEY_SETTING, None) or _drawn.setdefault(spark.sparkContext.applicationId, secrets.token_hex(32))


_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
# fixed values: lengths of the registry of IBANs; printed in groups of four, where the length tells the last one
_IBAN = {
    15: "NO", 16: "BE", 18: "DK|FI|FK|FO|GL|NL|SD", 19: "MK|SI", 20: "AT|BA|EE|KZ|LT|LU|MN|XK", 21: "CH|HR|LI|LV", 22: "BG|BH|CR|DE|GB|GE|IE|ME|RS|VA", 23: "AE|GI|IL|IQ|OM|SO|TL", 24: "AD|CZ|ES|MD|PK|RO|SA|SE|SK|TN|VG",
    25: "LY|PT|ST", 26: "IS|TR", 27: "BI|DJ|FR|GR|IT|MC|MR|SM", 28: "AL|AZ|BY|CY|DO|GT|HN|HU|LB|NI|PL|SV", 29: "BR|EG|PS|QA|UA", 30: "JO|KW|MU|YE", 31: "MT|SC", 32: "LC", 33: "RU",
}
_PRINTED = "|".join(f"(?:{c})[0-9]{{2}}(?: [A-Z0-9]{{4}}){{{n // 4 - 1}}}" + (f" [A-Z0-9]{{{n % 4}}}" if n % 4 else "") for n, c in _IBAN.items())
RULES = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9-])",
    "iban": rf"(?<![A-Za-z0-9])(?:[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]{{11,30}}|{_PRINTED}|[A-Z]{{2}}[0-9]{{2}}(?: [A-Z0-9]{{4}}){{2,7}}(?: [A-Z0-9]{{1,3}})?)(?![A-Za-z0-9])",
    "ipv4": rf"(?<![A-Za-z0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?![A-Za-z0-9]|\.[0-9])",
    "date": r"(?<![A-Za-z0-9/.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}(?=T[0-9]{2}|(?![A-Za-z0-9/-]))|(?:[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4})(?![A-Za-z0-9/-]))",
    "ssn": r"(?<![A-Za-z0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9-])",
    "card": r"(?<![A-Za-z0-9])(?:[0-9]{13,19}|(?:[0-9]{4} ){3}[0-9]{4}|(?:[0-9]{4}-){3}[0-9]{4}|[0-9]{4} [0-9]{6} [0-9]{5}|[0-9]{4}-[0-9]{6}-[0-9]{5})(?![A-Za-z0-9])",
    "phone": r"(?<![A-Za-z0-9+])(?:(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-]?[0-9]{4}|\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,4})(?![A-Za-z0-9])",
}
#: At each place the first rule that matches takes its text.
PATTERN = "|".join(RULES.values())


def _prf(key: str, kind: str, i: Column, x: Column) -> Column:
    digest = F.sha2(F.concat_ws(":", F.lit(key), F.lit(kind), i.cast("string"), x.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def feistel(l: Column, r: Column, a, b, key: str, kind: str, finish) -> Column:  # noqa: E741
    """Permute (l, r) of Z_a x Z_b; ``finish`` makes a column of the two halves."""
    a, b = (x if isinstance(x, Column) else F.lit(x).cast("long") for x in (a, b))
    pair = lambda x, y: F.struct(x.cast("long").alias("l"), y.cast("long").alias("r"))
    step = lambda s, i: F.when(i % 2 == 0, pair((s["l"] + _prf(key, kind, i, s["r"])) % a, s["r"])).otherwise(pair(s["l"], (s["r"] + _prf(key, kind, i, s["l"])) % b))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), pair(l, r), step, lambda s: finish(s["l"], s["r"]))


def _bind(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _power(k: Column) -> Column:
    return F.pow(F.lit(10.0), k).cast("long")


def _digits(d: Column, key: str, kind: str) -> Column:
    """Permute a string of 2 to 19 digits among those of its length."""
    n = F.length(d)
    h = F.floor(n / 2).cast("int")
    tag = lambda x, k: F.lpad(x.cast("string"), k, "0")
    return feistel(d.substr(F.lit(1), h).cast("long"), d.substr(h + 1, n).cast("long"), _power(h), _power(n - h), key, kind, lambda l, r: F.concat(tag(l, h), tag(r, n - h)))


def _refill(shape: Column, d: Column) -> Column:
    """``shape`` with its digits replaced by those of ``d`` in order."""
    start = F.struct(F.lit("").alias("o"), F.lit(0).alias("k"))
    step = lambda s, c: F.when(c.between("0", "9"), F.struct(F.concat(s["o"], d.substr(s["k"] + 1, F.lit(1))).alias("o"), (s["k"] + 1).alias("k"))).otherwise(F.struct(F.concat(s["o"], c).alias("o"), s["k"].alias("k")))
    return F.aggregate(F.split(shape, ""), start, step, lambda s: s["o"])


def _luhn(d: Column) -> Column:
    """Luhn sum of digits, the last one counted once."""
    n = F.length(d)
    one = lambda i: d.substr(n - i, F.lit(1)).cast("int")
    twice = lambda x: F.when(x > 4, x * 2 - 9).otherwise(x * 2)
    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda s, i: s + F.when(i % 2 == 0, one(i)).otherwise(twice(one(i))))


def _card(m: Column, key: str) -> Column:
    def new(d):
        body = _digits(d.substr(F.lit(1), F.length(d) - 1), key, "card")
        return _bind(body, lambda x: _refill(m, F.concat(x, F.pmod(10 - _luhn(F.concat(x, F.lit("0"))) % 10, F.lit(10)).cast("string"))))

    return _bind(F.regexp_replace(m, "[^0-9]", ""), lambda d: F.when(_luhn(d) % 10 == 0, new(d)))


def _phone(m: Column, key: str) -> Column:
    head = F.when(m.startswith("+"), F.regexp_extract(m, r"^\+[0-9]{1,3}?(?=[ .(-])|^\+[0-9]", 0)).otherwise(F.lit(""))
    rest = lambda h: m.substr(F.length(h) + 1, F.length(m))
    return _bind(head, lambda h: F.concat(h, _refill(rest(h), _digits(F.regexp_replace(rest(h), "[^0-9]", ""), key, "phone"))))


def _ssn(m: Column, key: str) -> Column:
    area, group, serial = (m.substr(a, n).cast("int") for a, n in ((1, 3), (5, 2), (8, 4)))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    rank = area - 1 - F.when(area > 666, 1).otherwise(0)

    def text(l, r):  # noqa: E741
        low = F.floor(l / 99).cast("int") + 1
        return F.concat_ws("-", F.lpad((low + F.when(low >= 666, 1).otherwise(0)).cast("string"), 3, "0"), F.lpad((l % 99 + 1).cast("string"), 2, "0"), F.lpad((r + 1).cast("string"), 4, "0"))

    return F.when(valid, feistel(rank * 99 + group - 1, serial - 1, 898 * 99, 9999, key, "ssn", text))


def _ipv4(m: Column, key: str) -> Column:
    part = lambda i: F.split_part(m, F.lit("."), F.lit(i)).cast("long")
    two = lambda x: F.concat_ws(".", F.shiftright(x, 8).cast("string"), (x % 256).cast("string"))
    return feistel(part(1) * 256 + part(2), part(3) * 256 + part(4), 65536, 65536, key, "ipv4", lambda l, r: F.concat_ws(".", two(l), two(r)))


def _date(m: Column, key: str) -> Column:
    """ISO, day.month.year, or month/day/year (day/month/year where only that is valid)."""
    sep = F.when(m.contains("-"), "-").when(m.contains("/"), "/").otherwise(".")
    part = lambda i: F.split_part(m, sep, F.lit(i)).cast("int")
    iso, slash = m.contains("-"), m.contains("/")
    flip = slash & (part(1) <= 12)
    year = F.when(iso, part(1)).otherwise(part(3))
    month = F.when(iso, part(2)).when(flip, part(1)).otherwise(part(2))
    day = F.when(iso, part(3)).when(flip, part(2)).otherwise(part(1))
    last = F.when(month.isin(4, 6, 9, 11), 30).when(month != 2, 31).when((year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0)), 29).otherwise(28)
    valid = year.between(1800, 2199) & month.between(1, 12) & (day >= 1) & (day <= last)
    origin = F.lit("1800-01-01").cast("date")
    number = F.datediff(F.make_date(F.when(valid, year), F.when(valid, month), F.when(valid, day)), origin)
    shown = lambda d: (
        F.when(iso, F.date_format(d, "yyyy-MM-dd"))
        .when(flip, F.when(F.length(m) == 10, F.date_format(d, "MM/dd/yyyy")).otherwise(F.date_format(d, "M/d/yyyy")))
        .when(slash, F.when(F.length(m) == 10, F.date_format(d, "dd/MM/yyyy")).otherwise(F.date_format(d, "d/M/yyyy")))
        .otherwise(F.when(F.length(m) == 10, F.date_format(d, "dd.MM.yyyy")).otherwise(F.date_format(d, "d.M.yyyy")))
    )
    new = _bind(number, lambda n: feistel(F.floor(n / 773), n % 773, 189, 773, key, "date", lambda l, r: F.date_add(origin, (l * 773 + r).cast("int"))))
    return F.when(valid, _bind(new, shown))


def _shift(s: Column, digest: Column, by: int) -> Column:
    """Each letter and digit moved within its class by two hex digits of ``digest``."""
    n = F.length(s)

    def one(i):
        c = F.ascii(s.substr(i + 1, F.lit(1)))
        k = F.conv(digest.substr((i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("int") * by
        move = lambda low, size: F.chr((low + F.pmod(c - low + k, F.lit(size))).cast("long"))
        return F.when(c.between(48, 57), move(48, 10)).when(c.between(65, 90), move(65, 26)).when(c.between(97, 122), move(97, 26)).otherwise(s.substr(i + 1, F.lit(1)))

    return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), n - 1), one), "")).otherwise(F.lit(""))


def _classes(s: Column, tweak: Column, key: str, kind: str) -> Column:
    """Permute ASCII strings among those with the same class at each place."""
    n = F.length(s)
    h = F.floor(n / 2).cast("int")
    pair = lambda x, y: F.struct(x.alias("l"), y.alias("r"))
    digest = lambda i, x: F.sha2(F.concat_ws(":", F.lit(key), F.lit(kind), i.cast("string"), tweak, x), 256)
    step = lambda p, i: F.when(i % 2 == 0, pair(_shift(p["l"], digest(i, p["r"]), 1), p["r"])).otherwise(pair(p["l"], _shift(p["r"], digest(i, p["l"]), 1)))
    return F.aggregate(F.sequence(F.lit(0), F.lit(3)), pair(s.substr(F.lit(1), h), s.substr(h + 1, n)), step, lambda p: F.concat(p["l"], p["r"]))


def _email(m: Column, key: str) -> Column:
    """Addresses that differ in case alone get pseudonyms that do so too."""
    local, domain = F.split_part(m, F.lit("@"), F.lit(1)), F.split_part(m, F.lit("@"), F.lit(2))
    made = _classes(F.lower(local), F.lower(domain), key, "email")
    cased = F.zip_with(F.split(local, ""), F.split(made, ""), lambda o, c: F.when(o.between("A", "Z"), F.upper(c)).otherwise(c))
    return F.concat(F.array_join(cased, ""), F.lit("@"), domain)


def _mod97(s: Column) -> Column:
    """Remainder of an IBAN's digits, letters counting from 10."""

    def step(x, c):
        v = F.ascii(c)
        return F.when(v >= 65, (x * 100 + v - 55) % 97).otherwise((x * 10 + v - 48) % 97)

    return F.aggregate(F.split(s, ""), F.lit(0), step)


def _iban(m: Column, key: str) -> Column:
    def new(x):
        head, body = x.substr(1, 2), x.substr(F.lit(5), F.length(x))
        valid = _mod97(F.concat(body, x.substr(1, 4))) == 1
        made = lambda b: F.concat(head, F.lpad((98 - _mod97(F.concat(b, head, F.lit("00")))).cast("string"), 2, "0"), b)
        return F.when(valid, _bind(_classes(body, head, key, "iban"), made))

    bare = _bind(F.replace(m, F.lit(" "), F.lit("")), new)
    return F.when(m.contains(" "), F.regexp_replace(bare, "(.{4})(?=.)", "$1 ")).otherwise(bare)


MAKERS = {"email": _email, "iban": _iban, "ipv4": _ipv4, "date": _date, "ssn": _ssn, "card": _card, "phone": _phone}


def pseudonym(m: Column, key: str) -> Column:
    """The pseudonym of a matched text, null where it does not validate."""
    out = None
    for kind, make in MAKERS.items():
        test = m.contains("@") if kind == "email" else m.rlike(f"^(?:{RULES[kind]})$")
        out = F.when(test, make(m, key)) if out is None else out.when(test, make(m, key))
    return out


def _mapped(docs: DataFrame, text: str, key: str) -> DataFrame:
    """Adds _pieces (texts between matches), _found and _made (a pseudonym or null each)."""
    some = F.col(text).rlike("[0-9@]")  # no rule matches without one of these
    found = docs.withColumn("_found", F.when(some, F.regexp_extract_all(F.col(text), F.lit(PATTERN), F.lit(0))).otherwise(F.array().cast("array<string>")))
    cut = F.when(F.size("_found") > 0, F.split(F.col(text), PATTERN, -1))
    return found.withColumn("_pieces", cut).withColumn("_made", F.when(F.size("_found") > 0, F.transform("_found", lambda m: pseudonym(m, key))))


def _joined(text: str) -> Column:
    new = F.zip_with("_found", "_made", lambda m, p: F.coalesce(p, m))
    both = F.zip_with("_pieces", F.concat(new, F.array(F.lit(""))), lambda a, b: F.concat(a, b))
    return F.when(F.size("_found") > 0, F.array_join(both, "")).otherwise(F.col(text))


def pseudonymise(docs: DataFrame, key: str | None = None) -> DataFrame:
    """doc_id, n_replaced and text of each row with personal data replaced.

    ``key`` is secret: who has it can invert pseudonyms (see ``secret_key`` for None).
    Values that do not validate stay.  Null texts stay null with no
    replacement; null ids and repeated rows are kept; other columns are ignored;
    an empty table gives an empty result.
    """
    rows = _mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), "text", key or secret_key(docs.sparkSession))
    n = F.when(F.size("_found") > 0, F.size(F.filter("_made", lambda p: p.isNotNull()))).otherwise(0).cast("long")
    return rows.select("doc_id", n.alias("n_replaced"), _joined("text").alias("text"))


def pseudonymise_rows(docs: DataFrame, key: str | None = None) -> DataFrame:
    """``docs`` with all its columns and the text replaced; the table documents keeps its n_chars true."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = docs.columns.index("text")
    rows = _mapped(docs.toDF(*names), names[at], key or secret_key(docs.sparkSession)).withColumn("_new", _joined(names[at])).drop("_found", "_made", "_pieces")
    size = docs.columns.index("n_chars") if "n_chars" in docs.columns else -1
    kept = [F.col("_new") if i == at else F.char_length("_new").cast(docs.schema[i].dataType) if i == size else F.col(n) for i, n in enumerate(names)]
    return rows.select(*[c.alias(n) for c, n in zip(kept, names)]).toDF(*docs.columns)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op4_pii": op4_pii}
SQL: dict[str, str] = {}
