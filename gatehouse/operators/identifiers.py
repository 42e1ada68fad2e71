"""Validation and detection of financial, tax, vehicle, health and wallet identifiers.

All rules are CASE expressions and digit folds over one column: a narrow pass, no join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gatehouse.functions.bind import let
from gatehouse.functions.checksums import digit_at, luhn, mod97, weighted_sum
from gatehouse.functions.patterns import SPACE, SPACE_BODY
from gatehouse.operators.findings import pick

# IBAN length per country.
IBAN_LENGTH = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28,
    "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18,
    "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32,
    "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MN": 20, "MR": 27, "MT": 31, "MU": 30, "NI": 28, "NL": 18,
    "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "RU": 33, "SA": 24, "SC": 31, "SD": 18, "SE": 24, "SI": 19,
    "SK": 24, "SM": 27, "SO": 23, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20, "YE": 30,
}

# Card number prefix range, lengths, network; first match wins.
CARD_RANGES = [
    ("34-34", (15,), "Amex"),
    ("37-37", (15,), "Amex"),
    ("6011-6011", (16, 19), "Discover"),
    ("622126-622925", (16,), "Discover"),
    ("644-649", (16,), "Discover"),
    ("65-65", (16, 19), "Discover"),
    ("2221-2720", (16,), "Mastercard"),
    ("51-55", (16,), "Mastercard"),
    ("62-62", (16, 17, 18, 19), "UnionPay"),
    ("4-4", (13, 16, 19), "Visa"),
]

# EU VAT country, name, national pattern, check-digit rule.
VAT_RULES = [
    ("AT", "Austria", r"U\d{8}", None),
    ("BE", "Belgium", r"0\d{9}", None),
    ("BG", "Bulgaria", r"\d{9,10}", None),
    ("CY", "Cyprus", r"\d{8}[A-Z]", None),
    ("CZ", "Czechia", r"\d{8,10}", None),
    ("DE", "Germany", r"\d{9}", "de"),
    ("DK", "Denmark", r"\d{8}", None),
    ("EE", "Estonia", r"\d{9}", None),
    ("EL", "Greece", r"\d{9}", None),
    ("ES", "Spain", r"[A-Z0-9]\d{7}[A-Z0-9]", None),
    ("FI", "Finland", r"\d{8}", None),
    ("FR", "France", r"[A-Z0-9]{2}\d{9}", None),
    ("GR", "Greece", r"\d{9}", None),
    ("HR", "Croatia", r"\d{11}", None),
    ("HU", "Hungary", r"\d{8}", None),
    ("IE", "Ireland", r"\d{7}[A-Z]{1,2}", None),
    ("IT", "Italy", r"\d{11}", "it"),
    ("LT", "Lithuania", r"(\d{9}|\d{12})", None),
    ("LU", "Luxembourg", r"\d{8}", None),
    ("LV", "Latvia", r"\d{11}", None),
    ("MT", "Malta", r"\d{8}", None),
    ("NL", "Netherlands", r"\d{9}B\d{2}", "nl"),
    ("PL", "Poland", r"\d{10}", None),
    ("PT", "Portugal", r"\d{9}", None),
    ("RO", "Romania", r"\d{2,10}", None),
    ("SE", "Sweden", r"\d{12}", None),
    ("SI", "Slovenia", r"\d{8}", None),
    ("SK", "Slovakia", r"\d{10}", None),
]

# Valid two-digit EIN prefixes.
EIN_PREFIXES = """01 02 03 04 05 06 10 12 13 14 15 16 20 21 22 23 24 25 26 27 30 31 32 33 34 35 36 37 38 39 40 41 42 43 44 45 46
47 48 50 51 52 53 54 55 56 57 58 59 60 61 62 63 64 65 66 67 68 71 72 73 74 75 76 77 80 81 82 83 84 85 86 87 88 90 91 92 93 94
95 98 99""".split()

VIN_VALUES = ("0123456789ABCDEFGHJKLMNPRSTUVWXYZ", "012345678912345678123457923456789")
VIN_WEIGHTS = [8, 7, 6, 5, 4, 3, 2, 10, 0, 9, 8, 7, 6, 5, 4, 3, 2]
TYPES = ["eth_address", "iban", "ein", "ssn", "aba_routing", "npi", "credit_card", "swift_bic", "vin", "vat_eu", "sol_address"]

_RESULT = "struct<valid:boolean,checksum:string,normalized:string,detail:string>"


def _vat_pattern(p: str) -> str:
    return r"\A" + p.replace(r"\d", "[0-9]") + r"\z"


def reference_tables(spark: SparkSession) -> dict[str, DataFrame]:
    from gatehouse.sources.reference import local_table

    cards = []
    for i, (span, lengths, network) in enumerate(CARD_RANGES):
        lo, hi = span.split("-")
        cards.append((i, lo, hi, list(lengths), network))
    return {
        "iban_lengths": local_table(spark, sorted(IBAN_LENGTH.items()), "country string, length int"),
        "bins": local_table(spark, cards, "pos int, prefix_from string, prefix_to string, lengths array<int>, network string"),
        "vat_rules": local_table(spark, [(c, n, _vat_pattern(p), k) for c, n, p, k in VAT_RULES],
                                           "country string, name string, pattern string, checksum string"),
        "ein_prefixes": local_table(spark, [(p,) for p in EIN_PREFIXES], "prefix string"),
    }


def _squeeze(v: Column) -> Column:
    return F.regexp_replace(v, SPACE, "")


def _trim(v: Column) -> Column:
    return F.regexp_replace(v, rf"\A[{SPACE_BODY}]+|[{SPACE_BODY}]+\z", "")


def _result(valid: Column | bool, checksum: Column | str, normalized: Column | None = None, detail: Column | str | None = None) -> Column:
    c = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(c(valid).alias("valid"), c(checksum).alias("checksum"), c(normalized).cast("string").alias("normalized"),
                    c(detail).cast("string").alias("detail")).cast(_RESULT)


def _passed(ok: Column) -> Column:
    return F.when(ok, "pass").otherwise("fail")


def _iban(norm: Column) -> Column:
    want = pick(IBAN_LENGTH, F.substring(norm, 1, 2))
    ok = mod97(F.concat(norm.substr(F.lit(5), F.length(norm)), F.substring(norm, 1, 4))) == 1
    return (
        F.when(~norm.rlike(r"\A[A-Z]{2}[0-9]{2}[A-Z0-9]+\z"), _result(False, "fail", norm, "Invalid format"))
        .when(want.isNull(), _result(False, "not_applicable", norm, "Unknown country code"))
        .when(F.length(norm) != want, _result(False, "fail", norm, "Wrong length"))
        .otherwise(_result(ok, _passed(ok), norm, F.substring(norm, 1, 2)))
    )


def _aba(norm: Column) -> Column:
    ok = weighted_sum(norm, [3, 7, 1] * 3) % 10 == 0
    return F.when(~norm.rlike(r"\A[0-9]{9}\z"), _result(False, "fail", norm, "Must be exactly 9 digits")).otherwise(_result(ok, _passed(ok), norm))


def _bic(norm: Column) -> Column:
    return (
        F.when(~F.length(norm).isin(8, 11), _result(False, "not_applicable", norm, "Must be 8 or 11 characters"))
        .when(~norm.rlike(r"\A[A-Z]{6}[A-Z0-9]{2}([A-Z0-9]{3})?\z"), _result(False, "not_applicable", norm, "Invalid BIC structure"))
        .otherwise(_result(True, "not_applicable", norm, F.substring(norm, 5, 2)))
    )


def card_network(pan: Column) -> Column:
    out = None
    for span, lengths, network in CARD_RANGES:
        lo, hi = span.split("-")
        hit = F.substring(pan, 1, len(lo)).between(lo, hi) & F.length(pan).isin(list(lengths))
        out = F.when(hit, network) if out is None else out.when(hit, network)
    return out.otherwise("Unknown")


def mask_pan(pan: Column) -> Column:
    stars = F.concat(F.repeat(F.lit("*"), F.length(pan) - 4), F.right(pan, F.lit(4)))
    return F.regexp_replace(F.regexp_replace(stars, "(.{4})", "$1-"), "-$", "")


def _card(norm: Column) -> Column:
    ok = luhn(norm)
    network = card_network(norm)
    return F.when(~norm.rlike(r"\A[0-9]{13,19}\z"), _result(False, "fail", F.right(F.lpad(F.regexp_replace(norm, "[^0-9]", ""), 4, "0"), F.lit(4)), "Invalid format")).otherwise(
        _result(ok & (network != "Unknown"), _passed(ok), mask_pan(norm), network))


def _ein(t: Column) -> Column:
    prefix = F.substring(t, 1, 2)
    norm = F.concat(prefix, F.lit("-"), F.right(t, F.lit(7)))
    known = prefix.isin(EIN_PREFIXES)
    return F.when(~t.rlike(r"\A[0-9]{2}-?[0-9]{7}\z"), _result(False, "not_applicable", None, "Invalid format")).otherwise(
        _result(known, "not_applicable", norm, F.concat(F.when(known, "Prefix: ").otherwise("Invalid prefix: "), prefix)))


def _vat_checksum(kind: str, nat: Column) -> Column:
    if kind == "de":
        p = F.aggregate(F.sequence(F.lit(1), F.lit(8)), F.lit(10), lambda acc, i: _de_step((F.substring(nat, i, F.lit(1)).try_cast("int") + acc) % 10))
        return F.when(11 - p == 10, 0).otherwise(11 - p) == digit_at(nat, 9)
    if kind == "it":
        total = F.lit(0)
        for i in range(1, 11):
            d = digit_at(nat, i)
            total = total + (d if i % 2 else F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2))
        return (10 - total % 10) % 10 == digit_at(nat, 11)
    rest = weighted_sum(nat, [9, 8, 7, 6, 5, 4, 3, 2]) % 11
    return (rest <= 9) & (rest == digit_at(nat, 9))


def _de_step(s: Column) -> Column:
    return (F.when(s == 0, 10).otherwise(s) * 2 % 11).cast("int")


def _vat(norm: Column) -> Column:
    nat = norm.substr(F.lit(3), F.length(norm))
    name = pick({c: n for c, n, _, _ in VAT_RULES}, F.substring(norm, 1, 2))
    fits = pick({c: _vat_pattern(p) for c, _, p, _ in VAT_RULES}, F.substring(norm, 1, 2))
    ok = None
    for c, _, _, kind in VAT_RULES:
        if kind:
            cond = F.coalesce(_vat_checksum(kind, nat), F.lit(False))
            ok = F.when(F.substring(norm, 1, 2) == c, cond) if ok is None else ok.when(F.substring(norm, 1, 2) == c, cond)
    checked = F.substring(norm, 1, 2).isin([c for c, _, _, kind in VAT_RULES if kind])
    return (
        F.when(F.length(norm) < 4, _result(False, "not_applicable", None, "Too short"))
        .when(name.isNull(), _result(False, "not_applicable", norm, "Unknown EU VAT country"))
        .when(~F.regexp_like(nat, fits), _result(False, "not_applicable", norm, F.concat(name, F.lit(": format mismatch"))))
        .when(checked, _result(ok, _passed(ok), norm, name))
        .otherwise(_result(True, "not_applicable", norm, name))
    )


def _vin(norm: Column) -> Column:
    value = lambda text, i: F.translate(F.substring(text, i, 1), *VIN_VALUES).try_cast("int")
    rest = weighted_sum(norm, VIN_WEIGHTS, value) % 11
    ok = F.substring(norm, 9, 1) == F.when(rest == 10, "X").otherwise(rest.cast("string"))
    return (
        F.when(F.length(norm) != 17, _result(False, "fail", norm, "Must be exactly 17 characters"))
        .when(~norm.rlike(r"\A[A-HJ-NPR-Z0-9]{17}\z"), _result(False, "fail", norm, "Contains invalid characters"))
        .otherwise(_result(ok, _passed(ok), norm, F.when(~ok, "Check digit mismatch")))
    )


def _npi(norm: Column) -> Column:
    ok = luhn(F.concat(F.lit("80840"), norm))
    return F.when(~norm.rlike(r"\A[0-9]{10}\z"), _result(False, "fail", norm, "Must be exactly 10 digits")).otherwise(_result(ok, _passed(ok), norm))


def _ssn(t: Column) -> Column:
    area, group, serial = F.substring(t, 1, 3), F.substring(t, 4, 2), F.substring(t, 6, 4)
    why = (
        F.when(area == "000", "Area 000 is not valid").when(area == "666", "Area 666 is not valid")
        .when(area >= "900", "Areas 900 to 999 are not valid").when(group == "00", "Group 00 is not valid")
        .when(serial == "0000", "Serial 0000 is not valid")
    )
    return F.when(~t.rlike(r"\A[0-9]{9}\z"), _result(False, "not_applicable", None, "Invalid format")).otherwise(
        _result(why.isNull(), "not_applicable", F.concat(F.lit("***-**-"), serial), why))


def _eth(t: Column) -> Column:
    ok = t.rlike(r"\A0x[0-9a-fA-F]{40}\z")
    return _result(ok, "not_applicable", F.lower(t), F.when(~ok, "Must be 0x followed by 40 hex characters"))


def _sol(t: Column) -> Column:
    ok = t.rlike(r"\A[1-9A-HJ-NP-Za-km-z]{32,44}\z")
    return _result(ok, "not_applicable", t, F.when(~ok, "Must be 32 to 44 base58 characters"))


# Normal form of a value per type, then the rule over it.
_RULES = {
    "eth_address": (lambda v: _trim(v), _eth),
    "iban": (lambda v: _squeeze(F.upper(v)), _iban),
    "ein": (lambda v: _trim(v), _ein),
    "ssn": (lambda v: F.replace(_trim(v), F.lit("-"), F.lit("")), _ssn),
    "aba_routing": (lambda v: F.regexp_replace(v, rf"[{SPACE_BODY}-]", ""), _aba),
    "npi": (lambda v: _squeeze(v), _npi),
    "credit_card": (lambda v: F.regexp_replace(v, rf"[{SPACE_BODY}-]", ""), _card),
    "swift_bic": (lambda v: _trim(F.upper(v)), _bic),
    "vin": (lambda v: _trim(F.upper(v)), _vin),
    "vat_eu": (lambda v: _squeeze(_trim(F.upper(v))), _vat),
    "sol_address": (lambda v: _trim(v), _sol),
}


def _check(name: str, value: Column) -> Column:
    normal, rule = _RULES[name]
    return let(normal(value), rule)


def identifier_type(value: Column) -> Column:
    """First type of a fixed order whose shape fits; ``unknown`` otherwise."""
    t = _trim(value)
    up = F.upper(t)
    packed = _squeeze(up)
    vat = F.coalesce(F.regexp_like(up.substr(F.lit(3), F.length(up)), pick({c: _vat_pattern(p) for c, _, p, _ in VAT_RULES}, F.substring(up, 1, 2))), F.lit(False))
    tests = {
        "eth_address": t.rlike(r"\A0x[0-9a-fA-F]{40}\z"),
        "iban": packed.rlike(r"\A[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}\z") & F.substring(packed, 1, 2).isin(list(IBAN_LENGTH)),
        "ein": t.rlike(r"\A[0-9]{2}-[0-9]{7}\z"),
        "ssn": t.rlike(r"\A[0-9]{3}-[0-9]{2}-[0-9]{4}\z"),
        "aba_routing": t.rlike(r"\A[0-9]{9}\z"),
        "npi": t.rlike(r"\A[0-9]{10}\z"),
        "credit_card": F.regexp_replace(t, rf"[{SPACE_BODY}-]", "").rlike(r"\A[0-9]{13,19}\z"),
        "swift_bic": t.rlike(r"\A[A-Za-z]{6}[A-Za-z0-9]{2}([A-Za-z0-9]{3})?\z"),
        "vin": up.rlike(r"\A[A-HJ-NPR-Z0-9]{17}\z"),
        "vat_eu": (F.length(t) >= 4) & vat,
        "sol_address": t.rlike(r"\A[1-9A-HJ-NP-Za-km-z]{32,44}\z"),
    }
    out = None
    for name in TYPES:
        out = F.when(tests[name], name) if out is None else out.when(tests[name], name)
    return out.otherwise("unknown")


def detect_identifier_type(df: DataFrame, value_col: str, out: str = "id_type") -> DataFrame:
    return df.withColumn(out, identifier_type(F.col(value_col)))


def validate_identifiers(df: DataFrame, value_col: str, type_col: str | None = None) -> DataFrame:
    """Adds ``id_type, valid, checksum, normalized, detail``; the type is detected where it is not given."""
    kind = F.coalesce(F.col(type_col), identifier_type(F.col(value_col))) if type_col else identifier_type(F.col(value_col))
    typed = df.withColumn("id_type", kind)
    result = None
    for name in TYPES:
        checked = _check(name, F.col(value_col))
        result = F.when(F.col("id_type") == name, checked) if result is None else result.when(F.col("id_type") == name, checked)
    result = result.otherwise(_result(False, "not_applicable", None, "Could not determine identifier type"))
    return typed.withColumn("_r", result).select(*typed.columns, "_r.*")


def identifier_report(results: DataFrame, *by: str) -> DataFrame:
    known_bad = F.max((~F.col("valid") & (F.col("id_type") != "unknown")).cast("int"))
    unknown = F.max((F.col("id_type") == "unknown").cast("int"))
    return results.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("valid")).alias("valid"), F.count_if(~F.col("valid")).alias("invalid"),
        F.count_if(F.col("id_type") == "unknown").alias("unknown"),
        F.when(known_bad == 1, "BLOCK").when(unknown == 1, "FLAG").otherwise("PASS").alias("verdict"))
