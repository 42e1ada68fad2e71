"""Queries over statement, command and URL logs, identifiers, JSON columns, configuration documents and deadlines."""

from __future__ import annotations

from pyspark.sql import functions as F

from gatehouse.operators import command_log, config_docs, findings, identifiers, legal, quality, sql_log, url_log
from gatehouse.plans.inputs import ctes, table
from gatehouse.plans.inputs import load
from gatehouse.plans.usage import _HOLIDAYS

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def _expected(cases: str, source: str, key: str) -> str:
    """Golden findings per template: ``position, rule`` lists joined to every row made from the template."""
    return f"with {ctes(source)}, golden(k, position, rule_id, severity) as (values {cases}) select id as subject_id, position, rule_id, severity from {source} join golden on k = {key}"


_F = ["subject_id", "position", "rule_id", "severity"]


# Statement, command and URL logs -----------------------------------------------------------------------
@query("sql_log_findings", _expected("""(0, 0, 'SQL-SELECT-STAR-NO-LIMIT', 'low'), (1, 0, 'SQL-UNBOUNDED-WRITE', 'critical'), (2, 0, 'SQL-ALWAYS-TRUE', 'high'),
    (3, 1, 'SQL-STACKED', 'high'), (3, 1, 'SQL-DROP', 'critical'), (3, 1, 'SQL-COMMENT-TAIL', 'medium'), (5, 0, 'SQL-UNION-INJECTION', 'high'), (6, 0, 'SQL-GRANT-ALTER', 'high'),
    (7, 0, 'SQL-ALWAYS-TRUE', 'high'), (7, 0, 'SQL-COMMENT-TAIL', 'medium')""", "sql_log", "id % 8"))
def _(spark, d):
    return sql_log.sql_log_findings(load(spark, d, "sql_log"), "id", "sql").select(*_F)


@query("command_log_findings", _expected("""(1, 0, 'CMD-RM-RECURSIVE-ROOT', 'critical'), (3, 0, 'CMD-GIT-FORCE-PUSH-PROTECTED', 'high'), (3, 1, 'CMD-PRIVILEGE-ESCALATION', 'high'),
    (6, 0, 'CMD-ENV-SECRET-ECHO', 'low'), (6, 1, 'CMD-SHUTDOWN-REBOOT', 'medium'), (7, 0, 'CMD-CHMOD-WORLD-WRITABLE', 'high'), (7, 1, 'CMD-HISTORY-WIPE', 'medium'), (8, 2, 'CMD-CURL-INSECURE', 'medium')""", "command_log", "id % 9"))
def _(spark, d):
    return command_log.command_log_findings(load(spark, d, "command_log"), "id", "command").select(*_F)


@query("command_chain_findings", _expected("""(0, 0, 'CMD-REMOTE-EXEC-PIPE', 'critical'), (4, 1, 'CMD-EXFIL', 'high'), (8, 1, 'CMD-EXFIL', 'high')""", "command_log", "id % 9"))
def _(spark, d):
    return command_log.command_chain_findings(load(spark, d, "command_log"), "id", "command").select(*_F)


@query("command_verdicts", """with v as (select event_id, case when event_id % 9 in (0, 1, 3, 4, 7, 8) then 'BLOCK' when event_id % 9 = 6 then 'FLAG' else 'PASS' end as verdict from events)
    select verdict, count(*) as commands from v group by 1""")
def _(spark, d):
    log = load(spark, d, "command_log")
    found = command_log.command_log_findings(log, "id", "command").unionByName(command_log.command_chain_findings(log, "id", "command"))
    return findings.verdicts(found, log, subject_col="id").groupBy("verdict").agg(F.count(F.lit(1)).alias("commands"))


@query("url_log_findings", f"""with {ctes('url_log')}, golden(k, rule_id, severity) as (values (1, 'NET-PRIVATE-IP', 'high'), (2, 'NET-DECIMAL-IP-OBFUSCATION', 'high'), (2, 'NET-LOOPBACK', 'high'), (3, 'NET-OCTAL-HEX-IP', 'high'), (3, 'NET-LOOPBACK', 'high'),
    (4, 'NET-NONSTANDARD-PORT', 'low'), (5, 'NET-CREDENTIALS-IN-URL', 'medium'), (6, 'NET-METADATA-ENDPOINT', 'critical'), (6, 'NET-LINK-LOCAL', 'high'), (7, 'NET-SCHEME-DENIED', 'high'), (8, 'NET-LOOPBACK', 'high'), (9, 'NET-MALFORMED-URL', 'high'))
    select id as subject_id, rule_id, severity from url_log join golden on k = id % 10 where (k <> 4 or contains(url, ':8080/')) and (k <> 5 or contains(url, 'u:p@')) and (k <> 7 or url like 'ftp:%')""")
def _(spark, d):
    return url_log.url_log_findings(load(spark, d, "url_log"), "id", "url").select("subject_id", "rule_id", "severity")


@query("classify_ips", f"""with {ctes('ips')}, p as (select *, string_split(ip, '.') as o from ips), n as (select *, case when len(o) = 4 then cast(o[1] as int) end as a, case when len(o) = 4 then cast(o[2] as int) end as b, case when len(o) = 4 then cast(o[3] as int) end as c from p)
    select id, case when a is null then 6 else 4 end as ip_version, case when a is null then 'link-local' when a = 127 then 'loopback' when a = 10 or (a = 172 and b between 16 and 31) or (a = 192 and b = 168) then 'private'
    when a = 169 and b = 254 then 'link-local' when a = 0 or a >= 240 or (a = 100 and b between 64 and 127) or (a = 192 and b = 0 and c = 2) then 'reserved' else 'public' end as ip_class from n""")
def _(spark, d):
    return url_log.classify_ips(load(spark, d, "ips"), "ip").select("id", "ip_version", "ip_class")


@query("ip_ranges", f"""with {ctes('ips', 'ip_ranges')}, r as (select cidr, name, split_part(cidr, '/', 1) as net, try_cast(split_part(cidr, '/', 2) as int) as bits from ip_ranges where cidr like '%/%'),
    four as (select case when contains(net, ':') then replace(net, '::ffff:', '') else net end as net, case when contains(net, ':') then bits - 96 else bits end as bits, cidr, name from r where contains(net, '.')),
    num as (select *, string_split(net, '.') as o from four), ranges as (select bits, cidr, name, (cast(o[1] as bigint) * 16777216 + cast(o[2] as bigint) * 65536 + cast(o[3] as bigint) * 256 + cast(o[4] as bigint)) >> (32 - bits) as p from num),
    a as (select distinct ip, case when contains(ip, '.') then list_reduce(list_transform(string_split(ip, '.'), lambda x: cast(x as bigint)), lambda t, x: t * 256 + x) end as n from ips),
    met as (select ip, bits, cidr, name from a join ranges on n is not null and n >> (32 - bits) = p
            union all select ip, bits, cidr, name from a join r on n is null and contains(net, 'fe80') and (bits < 128 or ip = net)),
    best as (select ip, arg_max(struct_pack(cidr := cidr, name := name), (bits, cidr, name)) as m from met group by ip)
    select id, ip, m.cidr as cidr, m.name as name from ips left join best using (ip)""")
def _(spark, d):
    """The longest range of each address, from a table of overlapping ranges."""
    return url_log.longest_prefix(load(spark, d, "ips"), "ip", load(spark, d, "ip_ranges"))


_HOSTS = "h as (select page_id, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) as host from pages), al as (select distinct host from h where page_id % 2 = 0), dn as (select distinct host from h where page_id % 5 = 0)"


@query("host_policy", f"""with {_HOSTS} select page_id as subject_id, host as matched, 'NET-OFF-ALLOWLIST' as rule_id from h where host not in (select host from al)
    union all select page_id, host, 'NET-DENYLISTED-HOST' from h where host in (select host from dn)""")
def _(spark, d):
    pages = table(spark, d, "pages")
    host = F.upper(F.regexp_extract("url", "^[a-z]+://([^/:?#]+)", 1)).alias("host")
    return url_log.host_policy(pages, "page_id", "url", pages.where("page_id % 2 = 0").select(host), pages.where("page_id % 5 = 0").select(host)).select("subject_id", "matched", "rule_id")


# Identifiers -------------------------------------------------------------------------------------------
_LUHN = ("list_sum(list_transform(range(1, length({d}) + 1), lambda i: case when i % 2 = 0 then (2 * cast({d}[length({d}) - i + 1] as int)) - (case when cast({d}[length({d}) - i + 1] as int) > 4 then 9 else 0 end) "
         "else cast({d}[length({d}) - i + 1] as int) end)) % 10 = 0")
_EIN = ", ".join(f"'{p}'" for p in identifiers.EIN_PREFIXES)
_IDS = f"""{ctes('identifiers')}, t as (select *, case id % 9 when 0 then 'aba_routing' when 1 then 'credit_card' when 2 then 'npi' when 3 then 'ein' when 4 then 'ssn' when 5 then 'vat_eu' when 6 then 'iban' when 7 then 'swift_bic' else 'unknown' end as id_type from identifiers),
    v as (select *, case id_type when 'aba_routing' then (3 * (cast(value[1] as int) + cast(value[4] as int) + cast(value[7] as int)) + 7 * (cast(value[2] as int) + cast(value[5] as int) + cast(value[8] as int)) + cast(value[3] as int) + cast(value[6] as int) + cast(value[9] as int)) % 10 = 0
      when 'credit_card' then {_LUHN.format(d='value')} when 'npi' then {_LUHN.format(d="('80840' || value)")} when 'ein' then value[1:2] in ({_EIN})
      when 'ssn' then value[1:3] not in ('000', '666') and value[1] <> '9' and value[5:6] <> '00' and value[8:11] <> '0000'
      when 'vat_eu' then list_reduce(list_transform(range(3, 11), lambda i: cast(value[i] as int)), lambda p, x: (case when (x + p) % 10 = 0 then 10 else (x + p) % 10 end) * 2 % 11, 10) + cast(value[11] as int) in (1, 11)
      when 'iban' then cast(value[9:] || '161100' || value[3:4] as hugeint) % 97 = -1
      when 'swift_bic' then true else false end as valid from t)"""
# IBAN letters of the template: GB -> 1611, WEST -> 32142829; the number is reduced in two steps to stay in range.
_IDS = _IDS.replace("cast(value[9:] || '161100' || value[3:4] as hugeint) % 97 = -1",
                    "cast(cast(cast('32142829' || value[9:] as hugeint) % 97 as varchar) || '1611' || value[3:4] as hugeint) % 97 = 1")


@query("detect_identifier_type", f"with {_IDS} select id, id_type from t")
def _(spark, d):
    return identifiers.detect_identifier_type(load(spark, d, "identifiers"), "value").select("id", "id_type")


@query("validate_identifiers", f"with {_IDS} select id, id_type, valid from v")
def _(spark, d):
    return identifiers.validate_identifiers(load(spark, d, "identifiers"), "value").select("id", "id_type", "valid")


# The first eleven characters of the number but the check digit weigh 249; the rest are digits.
@query("validate_vins_and_wallets", f"""with {ctes('vins_and_wallets')}, t as (select *, case when id % 4 = 0 then 'vin' when id % 4 = 1 and id % 3 <> 0 then 'eth_address'
      when id % 4 = 2 and not contains(value, 'l') then 'sol_address' else 'unknown' end as id_type from vins_and_wallets),
    w as (select *, (249 + 7 * cast(value[12] as int) + 6 * cast(value[13] as int) + 5 * cast(value[14] as int) + 4 * cast(value[15] as int) + 3 * cast(value[16] as int) + 2 * cast(value[17] as int)) % 11 as rest from t where id_type = 'vin')
    select id, id_type, value[9] = '0123456789X'[rest + 1] as valid from w union all select id, id_type, id_type <> 'unknown' from t where id_type <> 'vin'""")
def _(spark, d):
    return identifiers.validate_identifiers(load(spark, d, "vins_and_wallets"), "value").select("id", "id_type", "valid")


@query("identifier_report", f"""with {_IDS} select batch, count(*) as total, count(*) filter (valid) as valid, count(*) filter (not valid) as invalid, count(*) filter (id_type = 'unknown') as unknown,
    case when bool_or(not valid and id_type <> 'unknown') then 'BLOCK' when bool_or(id_type = 'unknown') then 'FLAG' else 'PASS' end as verdict from v group by batch""")
def _(spark, d):
    return identifiers.identifier_report(identifiers.validate_identifiers(load(spark, d, "identifiers"), "value"), "batch")


# Field rules -------------------------------------------------------------------------------------------
SPEC = {
    "fields": {
        "amount": {"type": "number", "required": True, "min": 1, "max": 200, "unit": "cents"},
        "kind": {"type": "string", "required": True, "enum": ["view", "click", "error"], "minLength": 5, "pattern": "^[a-v]+$"},
        "note": {"type": "string"},
        "limit": {"type": "integer", "unit": "percent"},
    },
    "rules": [{"left": "amount", "op": "lte", "right": "limit"}, {"left": "kind", "op": "neq", "right": {"const": "error"}}],
}
_AMOUNT = "a as (select event_id as id, event_type, user_id, case when event_id % 4 = 0 then value else floor(value) end as amount, event_id % 10 <> 0 as has_kind from events)"
_UNITS = """units as (select id, 'amount' as path, 'unit-coercion' as rule, 'medium' as severity from a where amount <> floor(amount) union all select id, 'amount', 'unit-coercion', 'medium' from a where amount > 0 and amount < 1
    union all select id, 'limit', 'unit-coercion', 'medium' from a where user_id > 100)"""


@query("check_fields", f"""with {_AMOUNT}, {_UNITS} select id as subject_id, path, rule, severity from (select * from units union all select id, 'amount', 'min', 'medium' from a where amount < 1 union all select id, 'amount', 'max', 'medium' from a where amount > 200
    union all select id, 'kind', 'required', 'critical' from a where not has_kind union all select id, 'kind', 'enum', 'high' from a where has_kind and event_type not in ('view', 'click', 'error')
    union all select id, 'kind', 'minLength', 'medium' from a where has_kind and length(event_type) < 5 union all select id, 'kind', 'pattern', 'medium' from a where has_kind and event_type = 'view'
    union all select id, 'note', 'null', 'high' from a where id % 6 = 0 union all select id, 'extra', 'unknown', 'low' from a where id % 15 = 0)""")
def _(spark, d):
    return quality.check_fields(load(spark, d, "tool_calls"), "id", "args", SPEC)


@query("unit_heuristics", f"with {_AMOUNT}, {_UNITS} select id as subject_id, path, rule, severity from units")
def _(spark, d):
    return quality.unit_heuristics(load(spark, d, "tool_calls"), "id", "args", SPEC)


@query("cross_field_rules", f"""with {_AMOUNT} select id as subject_id, '__cross__.amount' as path, 'cross-field.lte' as rule, 'high' as severity from a where amount > user_id
    union all select id, '__cross__.kind', 'cross-field.neq', 'high' from a where has_kind and event_type = 'error'""")
def _(spark, d):
    return quality.cross_field_rules(load(spark, d, "tool_calls"), "id", "args", SPEC["rules"])


@query("tool_argument_findings", f"""with f as ({ORACLE['check_fields']}), x as ({ORACLE['cross_field_rules']}), n as (select * from f union all select * from x)
    select subject_id, rule as rule_id, severity, path as matched from n""")
def _(spark, d):
    return quality.tool_argument_findings(load(spark, d, "tool_calls"), "id", "args", SPEC).select("subject_id", "rule_id", "severity", "matched")


@query("tool_argument_verdicts", f"""with f as ({ORACLE['check_fields']}), x as ({ORACLE['cross_field_rules']}), n as (select subject_id, severity from f union all select subject_id, severity from x),
    w as (select subject_id, max(case severity when 'critical' then 4 when 'high' then 3 when 'medium' then 2 else 1 end) as worst, count(*) as n from n group by subject_id)
    select event_id as subject_id, case when n is null then 'PASS' when worst >= 3 then 'BLOCK' else 'FLAG' end as verdict, coalesce(n, 0) as total_findings from events left join w on w.subject_id = event_id""")
def _(spark, d):
    from gatehouse.operators.findings import verdicts
    calls = load(spark, d, "tool_calls")
    found = quality.tool_argument_findings(calls, "id", "args", SPEC)
    return verdicts(found, calls.select(F.col("id").alias("subject_id"))).select("subject_id", "verdict", "total_findings")


@query("check_column_fields", """select c_custkey as subject_id, 'c_acctbal' as path, 'min' as rule, 'medium' as severity from customer where c_acctbal < 0
    union all select c_custkey, 'c_mktsegment', 'enum', 'high' from customer where c_mktsegment not in ('BUILDING', 'MACHINERY') union all select c_custkey, 'c_nationkey', 'unknown', 'low' from customer""")
def _(spark, d):
    """Typed columns checked through the same specification."""
    spec = {"fields": {"c_acctbal": {"type": "number", "min": 0}, "c_mktsegment": {"type": "string", "enum": ["BUILDING", "MACHINERY"]}}}
    rows = quality.columns_as_json(table(spark, d, "customer"), ["c_acctbal", "c_mktsegment", "c_nationkey"])
    return quality.check_fields(rows, "c_custkey", "args", spec)


SCHEMA = {
    "type": "object", "required": ["k", "t"], "additionalProperties": False,
    "properties": {
        "k": {"type": "integer", "minimum": 5, "exclusiveMaximum": 90, "multipleOf": 3},
        "t": {"type": "string", "maxLength": 6, "pattern": "^[a-z]+$", "enum": ["view", "click", "error", "signup", "purchase"]},
        "tags": {"type": "array", "minItems": 1, "uniqueItems": True, "items": {"type": "string", "minLength": 5}},
    },
}
_JSON = """j as (select event_id as id, event_type as t, cast(regexp_extract(props, '[0-9]+') as int) as k from events),
    e as (select id, '/k' as path, 'minimum' as keyword from j where k < 5 union all select id, '/k', 'exclusiveMaximum' from j where k >= 90 union all select id, '/k', 'multipleOf' from j where k % 3 <> 0
      union all select id, '/t', 'maxLength' from j where length(t) > 6 union all select id, '/tags', 'uniqueItems' from j where id % 8 = 0 union all select id, '/tags/0', 'minLength' from j where length(t) < 5
      union all select id, '/tags/1', 'minLength' from j where length(t) < 5 and id % 8 = 0 union all select id, '/zz', 'additionalProperties' from j where id % 9 = 0)"""


@query("schema_conformance", f"with {_JSON} select id as subject_id, path, keyword from e")
def _(spark, d):
    return quality.schema_conformance(load(spark, d, "json_rows"), "id", "data", SCHEMA)


@query("schema_verdicts", f"with {_JSON}, n as (select id, count(*) as n from e group by id) select j.id as subject_id, coalesce(n, 0) as errors, case when n is null then 'PASS' else 'BLOCK' end as verdict from j left join n on n.id = j.id")
def _(spark, d):
    return quality.schema_verdicts(load(spark, d, "json_rows"), "id", "data", SCHEMA)


COMBINED = {
    "$defs": {"small": {"maximum": 40}, "a/b": {"type": "string", "minLength": 5}},
    "allOf": [{"properties": {"k": {"$ref": "#/$defs/small"}}}, {"required": ["t", "u"]}],
    "anyOf": [{"properties": {"t": {"const": "view"}}}, {"properties": {"k": {"minimum": 30}}}],
    "oneOf": [{"properties": {"k": {"multipleOf": 2}}}, {"properties": {"k": {"multipleOf": 3}}}],
    "not": {"required": ["zz"]},
    "properties": {"tags": {"items": {"$ref": "#/$defs/a~1b", "type": "integer"}}, "k": {"not": {"anyOf": [{"const": 7}, {"const": 8}]}}, "t": {"$ref": "#/$defs/absent"}},
}


@query("schema_combinators", """with j as (select event_id as id, event_type as t, cast(regexp_extract(props, '[0-9]+') as int) as k from events)
    select id as subject_id, '/k' as path, 'maximum' as keyword from j where k > 40 union all select id, '', 'required' from j union all select id, '', 'anyOf' from j where t <> 'view' and k < 30
    union all select id, '', 'oneOf' from j where (k % 2 = 0) = (k % 3 = 0) union all select id, '', 'not' from j where id % 9 = 0 union all select id, '/tags/0', 'minLength' from j where length(t) < 5
    union all select id, '/tags/1', 'minLength' from j where length(t) < 5 and id % 8 = 0 union all select id, '/k', 'not' from j where k in (7, 8) union all select id, '/t', '$ref' from j""")
def _(spark, d):
    return quality.schema_conformance(load(spark, d, "json_rows"), "id", "data", COMBINED)


# Configuration documents -------------------------------------------------------------------------------
@query("terraform_findings", """with p as (select p_partkey as id, p_partkey % 4 as k, p_size as s from part)
    select id as subject_id, 'r' || id as matched, 'TF-CHG-001' as rule_id, 'high' as severity from p where k in (1, 2, 3) and s > 40 union all select id, 'r' || id, 'TF-SEC-001', 'high' from p where k = 0 and s > 20
    union all select id, 'r' || id, 'TF-SEC-002', 'critical' from p where k = 2 and s > 30 union all select id, 'r' || id, 'TF-SEC-003', 'critical' from p where k = 1 and s > 10
    union all select id, 'r' || id, 'TF-SEC-004', 'medium' from p where (k = 1 and s <= 25) or (k = 3 and s <= 35)""")
def _(spark, d):
    return config_docs.terraform_findings(load(spark, d, "plans"), "id", "doc").select("subject_id", "matched", "rule_id", "severity")


@query("iam_findings", """with p as (select p_partkey as id, p_partkey % 3 as k, p_size as s from part)
    select id as subject_id, 'Statement:s1' as matched, 'IAM-WILDCARD-ACTION' as rule_id from p where k = 0 union all select id, 'Statement:s1', 'IAM-WILDCARD-RESOURCE' from p where s % 2 = 0 and s > 25
    union all select id, 'Statement:s1', 'IAM-PASSROLE-STAR' from p where k = 1 and s % 2 = 0 and s > 25 union all select id, 'Statement:Statement[1]', 'IAM-NOTACTION' from p
    union all select id, 'Statement:Statement[1]', 'IAM-WILDCARD-PRINCIPAL' from p""")
def _(spark, d):
    return config_docs.iam_findings(load(spark, d, "policies"), "id", "doc").select("subject_id", "matched", "rule_id")


@query("k8s_findings", """with p as (select p_partkey as id, p_partkey % 3 as k, p_size as s from part where p_partkey % 2 = 0)
    select id as subject_id, 'Pod/m' as matched, 'K8S-HOST-NETWORK' as rule_id from p where s > 25 union all select id, 'Pod/m/container:c', 'K8S-LATEST-TAG' from p where k <> 1
    union all select id, 'Pod/m/container:c', 'K8S-NO-RESOURCE-LIMITS' from p union all select id, 'Pod/m/container:c', 'K8S-PRIVILEGED' from p where s > 40""")
def _(spark, d):
    return config_docs.k8s_findings(load(spark, d, "manifests"), "id", "doc").select("subject_id", "matched", "rule_id")


# Deadlines ---------------------------------------------------------------------------------------------
_CAL = f"""{_HOLIDAYS}, {ctes('deadline_rows')}, days as (select cast(d as date) as date from generate_series(date '2019-01-01', date '2037-12-31', interval 1 day) g(d)),
    cal as (select date, isodow(date) >= 6 as we, date in (select date from hol) as ho from days), court as (select date, row_number() over (order by date) as i from cal where not we and not ho),
    r as (select *, try_cast(start as date) as d from deadline_rows), ok as (select *, d is not null and days >= 0 and (mode = 'calendar' or year(d) between 2020 and 2035) as good from r),
    base as (select ok.*, (select count(*) from court c where c.date <= ok.d) as upto, (select count(*) from court c where c.date < ok.d) as below from (select distinct d from ok) ok),
    pos as (select o.*, case when direction = 'after' then upto + days else below - days + 1 end as target from ok o left join base b on b.d = o.d),
    ends as (select p.*, case when not good then null when mode = 'calendar' then (case direction when 'after' then d + days else d - days end) when days = 0 then d else c.date end as e from pos p left join court c on c.i = p.target)"""


@query("deadlines", f"""with {_CAL} select id, case when good then 'PASS' else 'BLOCK' end as verdict, coalesce(strftime(e, '%Y-%m-%d'), start) as deadline, mode, direction,
    case when good and mode = 'court' and days > 0 then (select count(*) from cal where we and date > least(d, e) and date < greatest(d, e)) else 0 end as skipped_weekend_days,
    case when good and mode = 'court' and days > 0 then (select count(*) from cal where ho and not we and date > least(d, e) and date < greatest(d, e)) else 0 end as skipped_holidays from ends""")
def _(spark, d):
    return legal.deadlines(load(spark, d, "deadline_rows"))


@query("skipped_holidays", f"with {_CAL} select id, hol.name, strftime(date, '%Y-%m-%d') as date from ends join hol on date > least(d, e) and date < greatest(d, e) where good and mode = 'court' and days > 0")
def _(spark, d):
    rows = load(spark, d, "deadline_rows")
    return legal.skipped_holidays(rows, legal.deadlines(rows)).select("id", "name", F.date_format("date", "yyyy-MM-dd").alias("date"))


@query("court_calendar", f"""with {_CAL}, o as (select distinct cast(o_orderdate + interval 28 years as date) as date from orders) select strftime(date, '%Y-%m-%d') as date, we as weekend, ho as holiday from o join cal using (date)""")
def _(spark, d):
    """Calendar rows of all order dates, moved into the holiday years."""
    days = table(spark, d, "orders").select(F.to_date(F.expr("o_orderdate + interval 28 years")).alias("date")).distinct()
    return days.join(legal.court_calendar(spark), "date").select(F.date_format("date", "yyyy-MM-dd").alias("date"), "weekend", "holiday")
