"""Unsafe outbound URLs in a log: schemes, credentials, address ranges, obfuscated hosts, ports."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatehouse.functions.bind import explode_rows, let
from gatehouse.operators.findings import as_findings, pick

# IPv4 ranges (first match wins), metadata hosts, default ports.
IPV4_RANGES = [
    ("127.0.0.0", 8, "loopback"), ("10.0.0.0", 8, "private"), ("172.16.0.0", 12, "private"), ("192.168.0.0", 16, "private"),
    ("169.254.0.0", 16, "link-local"), ("0.0.0.0", 8, "reserved"), ("100.64.0.0", 10, "reserved"), ("192.0.2.0", 24, "reserved"),
    ("240.0.0.0", 4, "reserved"),
]
METADATA_HOSTS = ["metadata.google.internal", "metadata.goog", "metadata"]
DEFAULT_PORTS = {"http": 80, "https": 443, "ws": 80, "wss": 443, "ftp": 21}
SPECIAL = ["http", "https", "ws", "wss", "ftp", "file"]


def _int(ip: str) -> int:
    a, b, c, d = map(int, ip.split("."))
    return (a << 24) | (b << 16) | (c << 8) | d


def ipv4_class(value: Column) -> Column:
    """Class of an address as an integer: nine constant ranges, so a CASE instead of a range join."""
    out = None
    for ip, bits, name in IPV4_RANGES:
        lo = _int(ip)
        inside = value.between(lo, lo + (1 << (32 - bits)) - 1)
        out = F.when(inside, name) if out is None else out.when(inside, name)
    return F.when(value.isNotNull(), out.otherwise("public"))


def _label_value(x: Column) -> Column:
    """Value of one label.  Leading zeros are free; more digits than these after them are over 32 bits in any place."""
    digits = lambda low, pattern: F.regexp_extract(low, pattern, 1)
    return let(F.lower(x), lambda low: (
        F.when(low == "0x", F.lit(0).cast("bigint"))
        .when(low.rlike(r"\A0x0*[0-9a-f]{1,12}\z"), F.conv(digits(low, r"\A0x0*([0-9a-f]{1,12})\z"), 16, 10).try_cast("bigint"))
        .when(low.rlike(r"\A0+[0-7]{1,16}\z"), F.conv(digits(low, r"\A0+([0-7]{1,16})\z"), 8, 10).try_cast("bigint"))
        .when(low.rlike(r"\A(?:0|[1-9][0-9]{0,11})\z"), low.try_cast("bigint"))))


def ipv4_number(host: Column) -> Column:
    """Numeric value of a dotted, decimal, octal or hexadecimal IPv4 host; NULL when it is none.  The last
    label fills all remaining bytes."""
    def total(parts: Column) -> Column:
        n = F.size(parts)
        last = F.get(parts, n - 1)
        weighted = F.transform(parts, lambda p, i: F.when(i < n - 1, p * F.pow(F.lit(256.0), 3 - i).cast("bigint")).otherwise(p))
        ok = n.between(1, 4) & F.forall(parts, lambda p: p.isNotNull()) & (last < F.pow(F.lit(256.0), 5 - n)) & (
            F.size(F.filter(parts, lambda p: p > 255)) - (last > 255).cast("int") == 0)
        return F.when(F.coalesce(ok, F.lit(False)), F.aggregate(weighted, F.lit(0).cast("bigint"), lambda a, p: a + p))

    labels = F.split(F.regexp_replace(host, r"\.\z", ""), r"\.")
    return let(F.transform(labels, _label_value), total)


def dotted(value: Column) -> Column:
    part = lambda s: F.shiftrightunsigned(value, s).bitwiseAND(F.lit(255)).cast("string")
    return F.when(value.isNotNull(), F.concat_ws(".", part(24), part(16), part(8), part(0)))


def _v6_text(host: Column) -> Column:
    """A dotted tail becomes two hexadecimal groups."""
    tail = F.regexp_extract(host, r"([0-9]{1,3}(?:\.[0-9]{1,3}){3})\z", 1)
    head = F.regexp_replace(host, r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}\z", "")
    return F.when(tail == "", host).otherwise(let(ipv4_number(tail), lambda v: F.concat(
        head, F.lower(F.hex(F.shiftrightunsigned(v, 16))), F.lit(":"), F.lower(F.hex(v.bitwiseAND(F.lit(65535)))))))


def ipv6_groups(host: Column) -> Column:
    """Eight group values, or NULL."""
    def parts(text: Column) -> Column:
        side = lambda s: F.filter(F.split(s, ":"), lambda g: g != "")
        fill = F.array_repeat(F.lit("0"), 8)
        left, right = side(F.substring_index(text, "::", 1)), side(F.substring_index(text, "::", -1))
        padded = let(F.struct(left.alias("l"), right.alias("r")), lambda x: F.concat(
            x["l"], F.slice(fill, F.lit(1), F.greatest(8 - F.size(x["l"]) - F.size(x["r"]), F.lit(0))), x["r"]))
        groups = F.when(F.contains(text, F.lit("::")), padded).otherwise(side(text))
        return F.when(text.rlike(r"\A[0-9a-fA-F:]+\z"), let(groups, lambda g: F.when(
            (F.size(g) == 8) & F.forall(g, lambda x: F.length(x) <= 4), F.transform(g, lambda x: F.conv(x, 16, 10).try_cast("bigint")))))

    return let(_v6_text(host), parts)


def ipv6_class(groups: Column) -> Column:
    g = lambda i: F.get(groups, i)
    zero = lambda n: F.forall(F.slice(groups, 1, n), lambda x: x == 0)
    mapped = g(6) * 65536 + g(7)
    return F.when(groups.isNotNull(), (
        F.when(zero(7) & (g(7) == 1), "loopback")
        .when(F.shiftright(g(0), 8).bitwiseAND(F.lit(254)) == 252, "private")
        .when(g(0).bitwiseAND(F.lit(0xFFC0)) == 0xFE80, "link-local")
        .when(zero(5) & (g(5) == 0xFFFF), ipv4_class(mapped))
        .when(zero(8), "reserved").otherwise("public")))


def classify_ips(df: DataFrame, ip_col: str) -> DataFrame:
    """Adds ``ip_version`` and ``ip_class`` to a table of addresses."""
    ip = F.col(ip_col)
    v4 = F.when(ip.rlike(r"\A[0-9]{1,3}(?:\.[0-9]{1,3}){3}\z"), ipv4_number(F.regexp_replace(ip, r"(?<![0-9])0+(?=[0-9])", "")))
    return df.withColumn("_v4", v4).withColumn("_v6", F.when(ip.contains(":"), ipv6_groups(ip))).select(
        *df.columns, F.when(F.col("_v4").isNotNull(), 4).when(F.col("_v6").isNotNull(), 6).alias("ip_version"),
        F.coalesce(ipv4_class(F.col("_v4")), let(F.col("_v6"), ipv6_class), F.lit("unknown")).alias("ip_class"))


def _address(text: Column) -> Column:
    """``struct(version, hi, lo)`` of an address, or NULL: 32 bits of an IPv4 address in ``hi``, or both halves of an IPv6 address.  An IPv4 address
    inside IPv6 (``::ffff:a.b.c.d``) is the IPv4 address."""
    v4 = F.when(text.rlike(r"\A[0-9]{1,3}(?:\.[0-9]{1,3}){3}\z"), ipv4_number(F.regexp_replace(text, r"(?<![0-9])0+(?=[0-9])", "")))
    half = lambda g, i: functools.reduce(lambda a, k: F.shiftleft(a, 16).bitwiseOR(F.get(g, k)), range(i + 1, i + 4), F.get(g, i))
    row = lambda version, hi, lo: F.struct(F.lit(version).alias("version"), hi.cast("long").alias("hi"), lo.cast("long").alias("lo"))
    mapped = lambda g: F.forall(F.slice(g, 1, 5), lambda x: x == 0) & (F.get(g, 5) == 0xFFFF)
    v6 = F.when(text.contains(":"), ipv6_groups(text))
    return F.coalesce(
        let(v4, lambda n: F.when(n.isNotNull(), row(4, n, F.lit(0)))),
        let(v6, lambda g: F.when(g.isNotNull(), F.when(mapped(g), row(4, half(F.concat(F.array_repeat(F.lit(0).cast("long"), 2), F.slice(g, 7, 2)), 0), F.lit(0))).otherwise(row(6, half(g, 0), half(g, 4))))))


def _masked(value: Column, width: int, bits: Column) -> Column:
    """The first ``bits`` of a number of ``width`` bits, the rest zero."""
    mask = F.call_function("shiftleft", F.lit(-1).cast("long"), F.lit(width) - bits)
    return F.when(bits <= 0, F.lit(0).cast("long")).when(bits >= width, value).otherwise(value.bitwiseAND(mask))


def _prefix(address: Column, length: Column) -> Column:
    """What addresses of one range share: the version, the length and the masked bits."""
    v4 = address["version"] == 4
    return F.struct(address["version"].alias("version"), length.alias("length"), F.when(v4, _masked(address["hi"], 32, length)).otherwise(_masked(address["hi"], 64, length)).alias("hi"),
                    F.when(v4, F.lit(0).cast("long")).otherwise(_masked(address["lo"], 64, length - 64)).alias("lo"))


def longest_prefix(df: DataFrame, ip_col: str, ranges: DataFrame, cidr_col: str = "cidr") -> DataFrame:
    """Adds the columns of ``ranges`` to a table of addresses: those of the longest range that holds the address, NULL where none does.

    ``ranges`` may have any size: each distinct address meets it by equality, once for each prefix length that occurs in it.  Ranges are ``address/length`` or a single
    address; bits beyond the length do not matter, ranges that cannot be read hold nothing, and of ranges repeated with other columns the greatest row counts.
    IPv4 addresses written inside IPv6 are IPv4.
    """
    rest = [c for c in ranges.columns if c != cidr_col]
    text, bits = F.trim(F.substring_index(cidr_col, "/", 1)), F.trim(F.substring_index(cidr_col, "/", -1))
    most = F.when(F.col("_a.version") == 4, 32).otherwise(128)
    given = F.when(F.contains(F.col(cidr_col), F.lit("/")), F.when(bits.rlike(r"\A[0-9]{1,3}\z"), bits.cast("int"))).otherwise(most)
    shift = F.when(text.contains(":") & (F.col("_a.version") == 4) & F.contains(F.col(cidr_col), F.lit("/")), 96).otherwise(0)
    read = ranges.withColumn("_a", _address(text)).where("_a is not null").withColumn("_n", given - shift).where((F.col("_n") >= 0) & (F.col("_n") <= most))
    known = read.select(_prefix(F.col("_a"), F.col("_n")).alias("_p"), F.struct(F.col(cidr_col), *rest).alias("_row")).groupBy("_p").agg(F.max("_row").alias("_row"))
    # To the driver: the lengths that occur, 33 and 129 at most.
    lengths = {v: sorted(r[1] for r in read.select("_a.version", "_n").distinct().collect() if r[0] == v) for v in (4, 6)}
    tried = lambda v: F.array(*map(F.lit, lengths[v])) if lengths[v] else F.array().cast("array<int>")
    asked = df.select(F.col(ip_col).alias("_ip")).where("_ip is not null").distinct().withColumn("_a", _address(F.col("_ip"))).where("_a is not null")
    each = explode_rows(asked, ["_ip", "_a"], F.when(F.col("_a.version") == 4, tried(4)).otherwise(tried(6)), "_n")
    met = each.select("_ip", "_n", _prefix(F.col("_a"), F.col("_n")).alias("_p")).join(known, "_p")
    best = met.groupBy("_ip").agg(F.max(F.struct("_n", "_row")).alias("_m"))
    return df.join(best.select(F.col("_ip").alias(ip_col), F.col("_m._row").alias("_row")), ip_col, "left").select(*[df[c] for c in df.columns], "_row.*")


def parse_urls(df: DataFrame, id_col: str, url_col: str) -> DataFrame:
    """Split by regex, since the built-in parser drops hosts that it does not accept."""
    url = F.trim(F.col(url_col))
    scheme = F.lower(F.regexp_extract(url, r"\A([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    special = scheme.isin(SPECIAL)
    rest = F.expr("substring(_u, length(_s) + 2)")
    base = df.select(F.col(id_col).alias("subject_id"), F.col(url_col).alias("url"), url.alias("_u"), scheme.alias("_s"), special.alias("_special"))
    base = base.withColumn("_auth", F.when(F.col("_special"), F.regexp_extract(rest, r"\A[/\\]*([^/\\?#]*)", 1))
                           .otherwise(F.regexp_extract(rest, r"\A//([^/?#]*)", 1)))
    base = base.withColumn("_hp", F.regexp_extract("_auth", r"([^@]*)\z", 1)).withColumn("_user", F.expr(
        "substring(_auth, 1, greatest(length(_auth) - length(_hp) - 1, 0))"))
    base = base.withColumn("_raw", F.regexp_extract("_hp", r"\A(\[[^\]]*\]?|[^:]*)", 1)).withColumn(
        "_port", F.regexp_extract("_hp", r"\A(?:\[[^\]]*\]|[^:\[]*):(.*)\z", 1))
    base = base.withColumn("_host", F.lower(F.regexp_replace("_raw", r"\A\[|\]\z", ""))).withColumn("_boxed", F.col("_raw").startswith("["))
    numeric_tail = F.col("_special") & ~F.col("_boxed") & F.col("_host").rlike(r"(?:\A|\.)(?:[0-9]+|0x[0-9a-f]*)\.?\z")
    base = base.withColumn("_num", numeric_tail).withColumn("_v4", F.when(F.col("_num"), ipv4_number(F.col("_host")))).withColumn(
        "_v6", F.when(F.col("_boxed"), ipv6_groups(F.col("_host"))))
    bad_port = ~F.col("_port").rlike(r"\A[0-9]*\z") | (F.col("_port").try_cast("bigint") > 65535)
    malformed = (
        (F.col("_s") == "") | (F.col("_special") & (F.col("_s") != "file") & (F.col("_host") == "")) | F.coalesce(bad_port, F.lit(False))
        | (F.col("_num") & F.col("_v4").isNull()) | (F.col("_boxed") & F.col("_v6").isNull())
        | F.col("_raw").rlike(r"[\x00-\x20<>^|%\\]")
    )
    port = F.when(F.col("_port") != "", F.col("_port").try_cast("int"))
    return base.select(
        "subject_id", "url", F.col("_s").alias("scheme"), malformed.alias("malformed"), F.col("_raw").alias("raw_host"),
        F.coalesce(dotted(F.col("_v4")), F.col("_host")).alias("host"),
        F.when(F.col("_v4").isNotNull(), "ipv4").when(F.col("_v6").isNotNull(), "ipv6").otherwise("hostname").alias("host_type"),
        F.coalesce(ipv4_class(F.col("_v4")), let(F.col("_v6"), ipv6_class), F.lit("unknown")).alias("ip_class"),
        F.when(F.col("_v6").isNotNull(), F.array_join(F.transform("_v6", lambda g: F.lower(F.hex(g))), ":")).alias("ipv6_text"),
        F.when(port != pick(DEFAULT_PORTS, F.col("_s"), -1), port).alias("port"),
        (F.regexp_replace("_user", "^:$", "") != "").alias("has_userinfo"))


def _finding(when: Column, rule: str, severity: str, message: str) -> Column:
    return F.when(when, F.struct(F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"), F.lit(message).alias("message")))


def url_log_findings(df: DataFrame, id_col: str, url_col: str, allow_schemes: list[str] | None = None, deny_private: bool = True,
                     allowed_ports: list[int] | None = None) -> DataFrame:
    p = parse_urls(df, id_col, url_col)
    ok = ~F.col("malformed")
    has_host = ok & (F.col("host") != "")
    ip = has_host & (F.col("host_type") != "hostname")
    v4 = has_host & (F.col("host_type") == "ipv4")
    rewritten = v4 & (F.lower("raw_host") != F.col("host"))
    all_digits = F.col("raw_host").rlike(r"\A[0-9]+\z")
    metadata = has_host & (
        ((F.col("host_type") == "ipv4") & (F.col("host") == "169.254.169.254")) | (F.col("ipv6_text") == "fd00:ec2:0:0:0:0:0:254")
        | ((F.col("host_type") == "hostname") & F.col("host").isin(METADATA_HOSTS)))
    port = has_host & F.col("port").isNotNull()
    if allowed_ports is not None:
        port = port & ~F.col("port").isin(allowed_ports)
    private = ip & (F.col("ip_class") == "private") if deny_private else F.lit(False)
    rules = F.array(
        _finding(F.col("malformed"), "NET-MALFORMED-URL", "high", "URL cannot be parsed"),
        _finding(ok & ~F.col("scheme").isin(allow_schemes or ["http", "https"]), "NET-SCHEME-DENIED", "high", "scheme not allowed"),
        _finding(ok & (F.col("host") == ""), "NET-NO-HOST", "high", "no host"),
        _finding(has_host & F.col("has_userinfo"), "NET-CREDENTIALS-IN-URL", "medium", "credentials in the URL"),
        _finding(rewritten & all_digits, "NET-DECIMAL-IP-OBFUSCATION", "high", "address written as one number"),
        _finding(rewritten & ~all_digits, "NET-OCTAL-HEX-IP", "high", "address in octal or hexadecimal"),
        _finding(metadata, "NET-METADATA-ENDPOINT", "critical", "cloud metadata endpoint"),
        _finding(ip & (F.col("ip_class") == "loopback"), "NET-LOOPBACK", "high", "loopback address"),
        _finding(private, "NET-PRIVATE-IP", "high", "private address"),
        _finding(ip & (F.col("ip_class") == "link-local"), "NET-LINK-LOCAL", "high", "link-local address"),
        _finding(ip & (F.col("ip_class") == "reserved"), "NET-RESERVED-IP", "medium", "reserved address"),
        _finding(has_host & (F.col("host_type") == "hostname") & F.col("host").rlike(r"xn--|[^\x00-\x7F]"), "NET-PUNYCODE-HOMOGRAPH", "medium", "internationalised host"),
        _finding(port, "NET-NONSTANDARD-PORT", "low", "port not allowed or not the default"),
    )
    hits = explode_rows(p, ["subject_id", F.col("host").alias("matched")], F.filter(rules, lambda r: r.isNotNull()), "f")
    return as_findings(hits.select("subject_id", "matched", "f.*").withColumn("category", F.lit("NET")), "url")


def host_policy(df: DataFrame, id_col: str, url_col: str, allow: DataFrame | None = None, deny: DataFrame | None = None) -> DataFrame:
    """``allow`` and ``deny`` hold one ``host`` column; comparison is exact and ignores case."""
    p = parse_urls(df, id_col, url_col).where("not malformed and host <> ''").select("subject_id", F.col("host").alias("matched"), F.lower("host").alias("k"))
    hosts = lambda t: t.select(F.lower("host").alias("k")).distinct()
    parts = []
    if allow is not None:
        parts.append(p.join(hosts(allow), "k", "left_anti").withColumn("rule_id", F.lit("NET-OFF-ALLOWLIST")))
    if deny is not None:
        parts.append(p.join(hosts(deny), "k", "left_semi").withColumn("rule_id", F.lit("NET-DENYLISTED-HOST")))
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return as_findings(out.withColumn("severity", F.lit("high")).withColumn("category", F.lit("NET")), "url")
