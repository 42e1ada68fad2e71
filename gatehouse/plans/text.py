"""Queries over text tables: personal data, secrets, injection, tokens, conversations, claims, imports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatehouse.operators import claims, distill, findings, imports, injection, legal, pii, secrets, tokens
from gatehouse.plans.inputs import ctes, plain, table
from gatehouse.plans.inputs import load
from gatehouse.sources import reference

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


# Oracle for spans: the engine's own regex dialect has an ASCII word boundary and no lookaround.
# Detector patterns, as in the operators.
_PATTERNS = [
    ("credit_card", "PCI", 4, True, 0.99, r"\b\d(?:[ -]?\d){12,18}\b"),
    ("us_ssn", "PII", 4, True, 0.9, r"\b\d{3}[- ]\d{2}[- ]\d{4}\b"),
    ("iban", "PCI", 3, True, 0.98, r"\b[A-Z]{2}\d{2}(?:\s?[A-Z0-9]){11,30}\b"),
    ("uk_nhs", "PHI", 3, True, 0.97, r"\b\d{3}[ -]?\d{3}[ -]?\d{4}\b"),
    ("ca_sin", "PII", 3, True, 0.9, r"\b\d{3}[ -]?\d{3}[ -]?\d{3}\b"),
    ("email", "PII", 2, True, 0.9, r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"),
    ("phone", "PII", 1, False, 0.5, r"(?:^|\W)((?:\+?1[ .\-]?)?(?:\(\d{3}\)[ .\-]?|\d{3}[ .\-])\d{3}[ .\-]\d{4})\b"),
    ("ip_address", "PII", 1, True, 0.6, r"\b(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)\b"),
]
_LUHN = ("list_sum(list_transform(range(1, length({d}) + 1), lambda i: case when i % 2 = 0 then "
         "(2 * cast({d}[length({d}) - i + 1] as int)) - (case when cast({d}[length({d}) - i + 1] as int) > 4 then 9 else 0 end) "
         "else cast({d}[length({d}) - i + 1] as int) end)) % 10 = 0")
_VALID = {
    "credit_card": _LUHN.format(d="d"), "ca_sin": _LUHN.format(d="d"),
    "us_ssn": "d[1:3] not in ('000', '666') and d[1] <> '9' and d[4:5] <> '00' and d[6:9] <> '0000'",
    "iban": "false",  # none in the data; the checksum is covered by golden tests
    "uk_nhs": "(11 - list_sum(list_transform(range(1, 10), lambda i: (11 - i) * cast(d[i] as int))) % 11) % 11 = cast(d[10] as int)",
}


def _hits_sql(split: str, patterns) -> str:
    parts = []
    for i, (name, cat, rank, ok, conf, rx) in enumerate(patterns):
        valid = _VALID.get(name, "true")
        # No lookbehind in this dialect: the phone pattern takes the character before and gives it back.
        raw = f"regexp_extract(m[i], '{rx}', 1)" if name == "phone" else "m[i]"
        parts.append(
            f"select doc_id, start, start + length(raw) as stop, '{name}' as rule_id, '{cat}' as category, {rank} as sev, {ok} as ok, {conf} as confidence, raw, {i} as det from "
            f"(select doc_id, {raw} as raw, regexp_replace(m[i], '[^0-9]', '', 'g') as d, list_sum(list_transform(p[1:i], lambda x: length(x))) "
            f"+ coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) + length(m[i]) - length({raw}) as start from "
            f"(select doc_id, regexp_extract_all(text, '{rx}') as m, {split}(text, '{rx}') as p from documents where regexp_matches(text, '{rx}')), "
            f"unnest(range(1, len(m) + 1)) as t(i)) where {valid}")
    return " union all ".join(parts)


_HITS = f"hits as ({_hits_sql('string_split_regex', _PATTERNS)})"
_SEV = "case sev when 4 then 'critical' when 3 then 'high' when 2 then 'medium' else 'low' end"
_KEPT = """ranked as (select *, row_number() over (partition by doc_id order by start, sev desc, ok desc, stop - start desc, det) as rn from hits),
    walk as (select doc_id, rn, stop as upto, true as keep from ranked where rn = 1
             union all select r.doc_id, r.rn, case when r.start >= w.upto then r.stop else w.upto end, r.start >= w.upto
             from walk w join ranked r on r.doc_id = w.doc_id and r.rn = w.rn + 1),
    kept as (select r.* from ranked r join walk w on w.doc_id = r.doc_id and w.rn = r.rn where w.keep)"""
_SPAN_COLS = (f"doc_id as subject_id, start, stop as \"end\", rule_id, category, {_SEV} as severity, ok as validated, confidence, "
              "regexp_replace(raw, '[A-Za-z0-9]', '*', 'g') as matched, "
              "(select length(text[1:start]) - length(replace(text[1:start], chr(10), '')) + 1 from documents d where d.doc_id = s.doc_id) as line")


def _span_out(df: DataFrame) -> DataFrame:
    return df.select("subject_id", "start", "end", "rule_id", "category", "severity", "validated", "confidence", "matched", "line")


@query("pii_spans_raw", f"with {_HITS} select {_SPAN_COLS} from hits s")
def _(spark, d):
    return _span_out(pii.pii_spans(docs(spark, d), "doc_id", "text", resolved=False))


@query("pii_spans", f"with recursive {_HITS}, {_KEPT} select {_SPAN_COLS} from kept s")
def _(spark, d):
    return _span_out(pii.pii_spans(docs(spark, d), "doc_id", "text"))


_CARDLESS = _HITS.replace("where " + _VALID["credit_card"], "where false", 1)


@query("pii_spans_allow_cards", f"with recursive {_CARDLESS}, {_KEPT} select doc_id as subject_id, rule_id, count(*) as n from kept group by all")
def _(spark, d):
    """An allow-listed detector is left out before overlaps are resolved."""
    return pii.pii_spans(docs(spark, d), "doc_id", "text", allow_types=["credit_card"]).groupBy("subject_id", "rule_id").agg(F.count(F.lit(1)).alias("n"))


@query("pii_redact", f"""with recursive {_HITS}, {_KEPT},
    pieces as (select *, lag(stop, 1, 0) over (partition by doc_id order by start) as prev from kept),
    joined as (select p.doc_id, string_agg(d.text[p.prev + 1:p.start] || '[REDACTED_' || upper(rule_id) || ']', '' order by p.start) as head, max(stop) as upto, count(*) as n
               from pieces p join documents d on d.doc_id = p.doc_id group by p.doc_id)
    select d.doc_id as subject_id, md5(case when j.n is null then d.text else j.head || d.text[j.upto + 1:] end) as redacted_md5, coalesce(n, 0) as total_findings
    from documents d left join joined j on j.doc_id = d.doc_id""")
def _(spark, d):
    return pii.redact(docs(spark, d), "doc_id", "text").select("subject_id", F.md5("redacted_text").alias("redacted_md5"), "total_findings")


_REPORT = f"""with recursive {_HITS}, {_KEPT}, rep as (
    select d.doc_id as subject_id, d.lang, d.source, count(k.rn) as total_findings, coalesce(max(k.sev), 0) as worst,
           coalesce(array_to_string(list_sort(list_distinct(list(k.category) filter (k.rn is not null))), ','), '') as categories,
           count(*) filter (k.sev = 1) as n_low, count(*) filter (k.sev = 2) as n_medium, count(*) filter (k.sev = 3) as n_high, count(*) filter (k.sev = 4) as n_critical
    from documents d left join kept k on k.doc_id = d.doc_id group by d.doc_id, d.lang, d.source),
    judged as (select *, case when total_findings = 0 then 'PASS' when worst >= 3 then 'BLOCK' else 'FLAG' end as verdict, total_findings = 0 as safe,
               case worst when 4 then 100 when 3 then 70 when 2 then 40 when 1 then 15 else 0 end as score from rep)"""


@query("pii_report", _REPORT + " select subject_id, lang, verdict, safe, score, categories, total_findings, n_low, n_medium, n_high, n_critical from judged")
def _(spark, d):
    return pii.pii_report(docs(spark, d), "doc_id", "text", keep=["lang"])


@query("pii_corpus_report", _REPORT + """ select lang, source, count(*) as texts, count(*) filter (verdict = 'PASS') as passed, count(*) filter (verdict = 'FLAG') as flagged,
    count(*) filter (verdict = 'BLOCK') as blocked, cast(sum(total_findings) as bigint) as findings, cast(sum(n_low) as bigint) as n_low, cast(sum(n_medium) as bigint) as n_medium,
    cast(sum(n_high) as bigint) as n_high, cast(sum(n_critical) as bigint) as n_critical, max(score) as worst_score from judged group by rollup(lang, source)""")
def _(spark, d):
    return pii.pii_corpus_report(docs(spark, d), "doc_id", "text", ["lang", "source"])


@query("verdicts", f"""with recursive {_HITS}, {_KEPT}, w as (select doc_id, max(sev) as worst, count(*) as n from kept group by doc_id)
    select d.doc_id as subject_id, case when n is null then 'PASS' when worst >= 2 then 'BLOCK' else 'FLAG' end as verdict,
           coalesce(worst, 0) as worst_rank, coalesce(n, 0) as total_findings from documents d left join w on w.doc_id = d.doc_id""")
def _(spark, d):
    t = docs(spark, d)
    return findings.verdicts(pii.pii_findings(t, "doc_id", "text"), t, "medium", subject_col="doc_id")


@query("verdicts_flag_mode", f"""with recursive {_HITS}, {_KEPT}, w as (select doc_id, count(*) as n from kept group by doc_id)
    select case when n is null then 'PASS' else 'FLAG' end as verdict, count(*) as subjects from documents d left join w on w.doc_id = d.doc_id group by 1""")
def _(spark, d):
    t = docs(spark, d)
    return findings.verdicts(pii.pii_findings(t, "doc_id", "text"), t, "high", "flag", "doc_id").groupBy("verdict").agg(F.count(F.lit(1)).alias("subjects"))


@query("severity_counts", f"""with recursive {_HITS}, {_KEPT} select doc_id as subject_id, count(*) filter (sev = 1) as low, count(*) filter (sev = 2) as medium,
    count(*) filter (sev = 3) as high, count(*) filter (sev = 4) as critical from kept group by doc_id""")
def _(spark, d):
    return findings.severity_counts(pii.pii_findings(docs(spark, d), "doc_id", "text"))


@query("suppress", f"""with recursive {_HITS}, {_KEPT} select rule_id, count(*) as n from kept where rule_id not in ('email', 'phone') group by rule_id""")
def _(spark, d):
    allow = spark.createDataFrame([("email",), ("phone",)], "rule_id string")
    return findings.suppress(pii.pii_findings(docs(spark, d), "doc_id", "text"), allow).groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))


@query("dedupe_findings", f"""with recursive {_HITS}, {_KEPT}, m as (select *, regexp_replace(raw, '[A-Za-z0-9]', '*', 'g') as matched from kept)
    select doc_id as subject_id, rule_id, matched, min(start) as start from m group by all""")
def _(spark, d):
    return findings.dedupe_findings(pii.pii_findings(docs(spark, d), "doc_id", "text")).select("subject_id", "rule_id", "matched", "start")


_KEYWORD = "(?i:api[_-]?key|apikey|access[_-]?key|secret[_-]?key|client[_-]?secret|auth[_-]?token|secret|token)"


_SECRET = f"{_KEYWORD}[\"'']?[ \\t]*[:=][ \\t]*[\"''][A-Za-z0-9_\\-]{{16,}}[\"'']"


@query("secret_spans", f"""with f as (select doc_id, regexp_extract_all(text, '{_SECRET}') as m, string_split_regex(text, '{_SECRET}') as p from documents)
    select doc_id as subject_id, 'generic_api_key' as rule_id, 'high' as severity, m[i][1:5] || '***...' || m[i][-4:] as matched,
           list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) as start
    from f, unnest(range(1, len(m) + 1)) as t(i)""")
def _(spark, d):
    return secrets.secret_spans(docs(spark, d), "doc_id", "text").select("subject_id", "rule_id", "severity", "matched", "start")


def _inj_sql() -> str:
    when = [f"case when regexp_matches(text, '{rx}') then {w} else 0 end" for _, rx, w in _INJ]
    labels = ", ".join(f"case when {' or '.join(f'''regexp_matches(text, '{rx}')''' for l2, rx, _ in _INJ if l2 == lab)} then '{lab}' end" for lab in dict.fromkeys(x[0] for x in _INJ))
    return (f"with {ctes('injected')}, p as (select conv_id, turn, least({' + '.join(when)}, 100) as points, concat_ws(',', {labels}) as patterns from injected) "
            "select conv_id, turn, case when points > 60 then 'injection' when points >= 30 then 'suspicious' else 'safe' end as risk, points / 100 as score, patterns from p")


_INJ = [(label, rx.replace("(?i)(?:(?<=[\\n\\r\\u2028\\u2029])|\\A)", "(?im)^") if "system:" in rx else rx.replace("‮", "‮").replace("‏", "‏"), w)
        for label, rx, w in injection.PATTERNS]


@query("injection_scores", _inj_sql())
def _(spark, d):
    return injection.injection_scores(load(spark, d, "injected"), ["conv_id", "turn"], "text")


@query("input_guard", f"""with s as ({_inj_sql()}) select conv_id, turn, risk = 'safe' as safe, case risk when 'safe' then 'pass' when 'suspicious' then 'flag' else 'block' end as status, score, patterns from s""")
def _(spark, d):
    return injection.input_guard(load(spark, d, "injected"), ["conv_id", "turn"], "text")


_TOKENS = """regexp_replace(text, '<\\|[^|]*?\\|>', '', 'g') as body, len(regexp_extract_all(text, '<\\|[^|]*?\\|>')) as special"""
_COUNT = """special + cast(case when len(regexp_extract_all(body, '[{}()\\[\\];=<>+\\-*/%&|!~^]')) * 100 > length(body) * 3 then ceil(length(body) / 3.5) else ceil(length(body) / 4.0) end as bigint)"""


@query("token_counts", f"""with t as (select doc_id, text, {_TOKENS} from documents), c as (select doc_id, {_COUNT} as tokens, length(text) as characters,
    len(regexp_extract_all(text, '[^\\s\\x{{a0}}]+')) as words from t)
    select doc_id, tokens, characters, words, tokens * 3.0 / 1000000 as input_cost_usd, 0.015 as output_cost_1k_usd from c""")
def _(spark, d):
    out = tokens.token_counts(docs(spark, d), ["doc_id"], "text", "claude")
    return out.withColumn("input_cost_usd", F.round("input_cost_usd", 9))


@query("conversation_tokens", f"""with t as (select conv_id, text, {_TOKENS} from conversations), c as (select conv_id, {_COUNT} as tokens from t),
    g as (select conv_id, count(*) as messages, cast(sum(tokens + 3) + 3 as bigint) as total_tokens from c group by conv_id)
    select conv_id, messages, total_tokens, round(total_tokens * 10.0 / 1000000, 9) as input_cost_usd, 0.03 as output_cost_1k_usd, 128000 - total_tokens as context_window_remaining from g""")
def _(spark, d):
    return tokens.conversation_tokens(table(spark, d, "conversations"), "conv_id", "text", "gpt-4").withColumn("input_cost_usd", F.round("input_cost_usd", 9))


ORACLE["token_counts"] = ORACLE["token_counts"].replace("tokens * 3.0 / 1000000 as", "round(tokens * 3.0 / 1000000, 9) as")

_TFIDF = """talk as (select conv_id, turn, text, list_filter(string_split(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: length(w) > 1) as terms
      from conversations where role <> 'system'),
    tf as (select conv_id, turn, term, count(*) as tf, max(n) as n from (select conv_id, turn, len(terms) as n, unnest(terms) as term from talk) group by all),
    dfreq as (select conv_id, term, count(*) as df from tf group by all), size as (select conv_id, count(*) as n_msgs from talk group by all),
    sc as (select tf.conv_id, turn, sum(tf / n * (ln((n_msgs + 1) / (df + 1)) + 1)) as s from tf join dfreq using (conv_id, term) join size using (conv_id) group by all),
    scored as (select t.conv_id, t.turn, round(coalesce(s, 0), 9) as score, length(t.text) as chars from talk t left join sc on sc.conv_id = t.conv_id and sc.turn = t.turn)"""


@query("tfidf_scores", f"with {_TFIDF.replace('group by all),', 'group by conv_id, turn, term),', 1)} select conv_id, turn, round(score, 6) as score from scored")
def _(spark, d):
    return distill.tfidf_scores(table(spark, d, "conversations")).withColumn("score", F.round("score", 6))


_DISTILL = f"""with recursive {_TFIDF.replace('group by all),', 'group by conv_id, turn, term),', 1)},
    back as (select *, row_number() over (partition by conv_id order by turn desc) as r from scored),
    sys as (select conv_id, sum(case when role = 'system' then length(text) else 0 end) as sys_chars, count(*) as original_count from conversations group by conv_id),
    room as (select s.conv_id, original_count, 150 * 4 - sys_chars - coalesce((select sum(chars) from back b where b.conv_id = s.conv_id and r <= 3), 0) as room from sys s),
    cand as (select *, row_number() over (partition by conv_id order by score desc, turn) as k from back where r > 3),
    walk as (select c.conv_id, c.k, c.turn, (room > 0 and chars <= room) as keep, case when room > 0 and chars <= room then room - chars else room end as room from cand c join room using (conv_id) where k = 1
             union all select c.conv_id, c.k, c.turn, w.room > 0 and c.chars <= w.room, case when w.room > 0 and c.chars <= w.room then w.room - c.chars else w.room end
             from walk w join cand c on c.conv_id = w.conv_id and c.k = w.k + 1),
    kept as (select conv_id, turn, 0 as part from conversations where role = 'system' union all select conv_id, turn, 1 from walk where keep union all select conv_id, turn, 2 from back where r <= 3)"""


@query("distill", _DISTILL + " select conv_id, turn, part from kept")
def _(spark, d):
    return distill.distill(table(spark, d, "conversations"), 150).select("conv_id", "turn", "part")


@query("distill_summary", _DISTILL + """ select conv_id, any_value(original_count) as original_count, count(*) as distilled_count, cast(ceil(sum(length(text)) / 4.0) as bigint) as estimated_tokens,
    floor(count(*) / any_value(original_count) * 100 + 0.5) / 100 as compression_ratio from kept join conversations using (conv_id, turn) join room using (conv_id) group by conv_id""")
def _(spark, d):
    return distill.distill_summary(table(spark, d, "conversations"), 150)


_CONTEXT = f"""{_DISTILL}, tk as (select conv_id, text, {_TOKENS} from conversations), ct as (select conv_id, {_COUNT} as tokens from tk),
    tot as (select conv_id, count(*) as original_count, cast(sum(tokens + 3) + 3 as bigint) as total_tokens from ct group by conv_id), over as (select conv_id from tot where total_tokens > 350)"""


@query("context_messages", _CONTEXT + """ select conv_id, turn from kept where conv_id in (select conv_id from over) union all select conv_id, turn from conversations where conv_id not in (select conv_id from over)""")
def _(spark, d):
    """What an agent goes on with: short conversations whole, long ones distilled."""
    return distill.manage_context(table(spark, d, "conversations"), "gpt-4", 350, 150)[0].select("conv_id", "turn")


@query("context_checks", _CONTEXT + """, n as (select conv_id, count(*) as n from kept group by conv_id), j as (select tot.*, total_tokens > 350 as distilled, case when total_tokens > 350 then coalesce(n, 0) else original_count end as kept_count from tot left join n using (conv_id))
    select conv_id, total_tokens, case when total_tokens < 350 then 'pass' else 'flag' end as status, distilled, original_count, kept_count, cast(100 - floor(kept_count * 100.0 / original_count + 0.5) as bigint) as savings_pct,
    case when distilled then 2 else 1 end as credits from j""")
def _(spark, d):
    return distill.manage_context(table(spark, d, "conversations"), "gpt-4", 350, 150)[1]


_URLB = "[^\\s\"'')\\]>]"
_CITE_CTE = f"""c1 as (select doc_id, unnest(regexp_extract_all(text, '\\b(10\\.\\d+(?:/{_URLB}*)?)', 1)) as t from cited),
    c2 as (select doc_id, unnest(regexp_extract_all(text, '(?i)arXiv:([^\\s"'')\\]>,]+)', 1)) as t from cited),
    cites as (select doc_id as subject_id, 'malformed_doi' as check_type, t as text, 0.7 as confidence from c1 where not regexp_matches(t, '^10\\.\\d{{4,}}/\\S+')
    union all select doc_id, 'malformed_arxiv_id', 'arXiv:' || t, 0.75 from c2 where not regexp_matches(t, '^\\d{{4}}\\.\\d{{4,5}}$') and not regexp_matches(t, '^[a-z-]+/\\d{{7}}$'))"""
_CITE_CTE = _CITE_CTE.replace("{{", "{").replace("}}", "}")


@query("citation_format_findings", f"with {ctes('cited')}, {_CITE_CTE} select subject_id, check_type, text, 'FLAG' as verdict, confidence from cites")
def _(spark, d):
    return claims.citation_format_findings(load(spark, d, "cited"), "doc_id", "text").select("subject_id", "check_type", "text", "verdict", "confidence")


_NUM_CTE = """s1 as (select doc_id, unnest(regexp_extract_all(text, '([^.!?\\n]+\\d+(?:\\.\\d+)?%[^.!?\\n]*\\d+(?:\\.\\d+)?%[^.!?\\n]*[.!?\\n])', 1)) as t from cited),
    s2 as (select doc_id, t, list_transform(regexp_extract_all(t, '(\\d+(?:\\.\\d+)?)\\s*%', 1), lambda x: cast(x as double)) as nums from s1),
    nums as (select doc_id as subject_id, 'numeric_contradiction' as check_type, trim(t, chr(10) || ' ' || chr(9)) as text, 0.6 as confidence from s2 where len(nums) >= 2 and (list_max(nums) > 100
      or (regexp_matches(t, '(?i)increas|improv|grew|better') and regexp_matches(t, '(?i)decreas|fell|worse|reduc'))))"""


@query("numeric_contradictions", f"with {ctes('cited')}, {_NUM_CTE} select subject_id, text, 'FLAG' as verdict from nums")
def _(spark, d):
    return claims.numeric_contradictions(load(spark, d, "cited"), "doc_id", "text").select("subject_id", "text", "verdict")


_LINK_CTE = f"""u as (select page_id, unnest(regexp_extract_all(text, 'https?://{_URLB}+')) as t from linked),
    links as (select page_id as subject_id, case when status is null then 'url_unreachable' else 'url_not_found' end as check_type, t as text,
    case when status is null then 'FLAG' else 'BLOCK' end as verdict from u left join crawl c on c.url = u.t
    where not regexp_matches(t, 'localhost|127\\.0\\.0\\.1|0\\.0\\.0\\.0') and (status is null or status in (404, 410)))"""


@query("link_status", f"with {ctes('linked', 'crawl')}, {_LINK_CTE} select * from links")
def _(spark, d):
    return claims.link_status(load(spark, d, "linked"), "page_id", "text", load(spark, d, "crawl")).select("subject_id", "check_type", "text", "verdict")


_IMPORTS = """imp as (select part_id as subject_id, language, unnest(case when language = 'python'
      then list_concat(list_transform(regexp_extract_all(code, '(?m)^import\\s+([\\w.]+)', 1), lambda x: x), regexp_extract_all(code, '(?m)^from\\s+([\\w.]+)\\s+import', 1))
      else list_concat(regexp_extract_all(code, '(?m)(?:^|\\s)import\\s+(?:[\\w*{}\\s,]+\\s+from\\s+)?[''"]([^''"./][^''"]*)[''"]', 1), regexp_extract_all(code, 'require\\s*\\(\\s*[''"]([^''"./][^''"]*)[''"]\\s*\\)', 1)) end) as path from snippets),
    names as (select distinct subject_id, language, case language when 'python' then 'PyPI' else 'npm' end as ecosystem, regexp_extract(path, '^[^./]*') as name from imp),
    found as (select * from names where name not in ('os', 'sys')),
    checked as (select f.*, case when r.name is null then 'hallucinated' else 'valid' end as status from found f left join registry r on r.ecosystem = f.ecosystem and r.name = f.name)"""


def _imports(spark, d):
    return imports.extract_imports(load(spark, d, "snippets"), "part_id", "code", "language")


def _osv(spark, d):
    # Packages are folded into each vulnerability's list, as the published feed has them.
    return load(spark, d, "osv_flat").groupBy("id", "summary", "db_severity", "score").agg(F.collect_set(F.struct("ecosystem", "name")).alias("affected")).withColumn(
        "details", F.lit(None).cast("string")).withColumn("aliases", F.array().cast("array<string>"))


@query("extract_imports", f"with {ctes('snippets', 'registry')}, {_IMPORTS} select subject_id, language, name from found")
def _(spark, d):
    return _imports(spark, d).select("subject_id", "language", "name")


@query("extract_imports_compiled", f"""with {ctes('snippets_compiled')} select part_id as subject_id, language, case language when 'rust' then 'serde' else case language when 'go' then 'go' else 'lib' end end || (part_id % 40) as name from snippets_compiled
    union all select part_id, language, replace(p_name, ' ', '_') from snippets_compiled where language = 'rust' union all select part_id, language, 'github' from snippets_compiled where language = 'go'""")
def _(spark, d):
    """Rust, Go and TypeScript."""
    return imports.extract_imports(load(spark, d, "snippets_compiled"), "part_id", "code", "language").select("subject_id", "language", "name")


@query("package_existence", f"with {ctes('snippets', 'registry')}, {_IMPORTS} select subject_id, ecosystem, name, status from checked")
def _(spark, d):
    return imports.package_existence(_imports(spark, d), load(spark, d, "registry")).select("subject_id", "ecosystem", "name", "status")


@query("hallucination_rate", f"""with {ctes('snippets', 'registry')}, {_IMPORTS} select language, count(*) as total, count(*) filter (status = 'valid') as valid,
    count(*) filter (status = 'hallucinated') as hallucinated, 0 as unknown, round(avg(case when status = 'hallucinated' then 1.0 else 0 end), 9) as hallucination_rate from checked group by language""")
def _(spark, d):
    checked = imports.package_existence(_imports(spark, d), load(spark, d, "registry"))
    return imports.hallucination_rate(checked, "language").withColumn("hallucination_rate", F.round("hallucination_rate", 9))


_VULN = """vul as (select distinct f.subject_id, f.ecosystem, f.name, o.id, case when db_severity <> '' then upper(db_severity) when score <> '' then score else 'UNKNOWN' end as severity, summary
    from found f join osv_flat o on o.ecosystem = f.ecosystem and o.name = f.name)"""


@query("vulnerabilities", f"with {ctes('snippets', 'registry', 'osv_flat')}, {_IMPORTS}, {_VULN} select subject_id, ecosystem, name, id, severity, summary from vul")
def _(spark, d):
    return imports.vulnerabilities(_imports(spark, d), _osv(spark, d)).drop("aliases")


@query("vulnerability_summary", f"""with {ctes('snippets', 'registry', 'osv_flat')}, {_IMPORTS}, {_VULN},
    t as (select subject_id, count(distinct name) as total_packages from found group by subject_id), b as (select subject_id, count(distinct name) as v, count(*) as n from vul group by subject_id)
    select t.subject_id, total_packages, coalesce(v, 0) as vulnerable_packages, coalesce(n, 0) as vulnerabilities, v is null as safe from t left join b using (subject_id)""")
def _(spark, d):
    return imports.vulnerability_summary(_imports(spark, d), _osv(spark, d))


def _outputs(spark, d):
    """Texts with citations, percentages and links next to code snippets, under disjoint subject ids."""
    text = load(spark, d, "cited").select(F.concat(F.lit("d"), "doc_id").alias("subject_id"), F.lit(None).cast("string").alias("language"), "text")
    page = load(spark, d, "linked").select(F.concat(F.lit("p"), "page_id").alias("subject_id"), F.lit(None).cast("string").alias("language"), "text")
    code = load(spark, d, "snippets").select(F.concat(F.lit("c"), "part_id").alias("subject_id"), "language", F.col("code").alias("text"))
    return text.unionByName(page).unionByName(code)


_ALL_CLAIMS = f"""with {ctes('cited', 'linked', 'crawl', 'snippets', 'registry')}, {_CITE_CTE}, {_NUM_CTE}, {_LINK_CTE}, {_IMPORTS},
    doc_links as (select 'd' || doc_id as subject_id, 'FLAG' as verdict from (select doc_id, unnest(regexp_extract_all(text, 'https?://{_URLB}+')) as t from cited) left join crawl c on c.url = t where c.url is null),
    claims as (select 'd' || subject_id as subject_id, 'FLAG' as verdict from cites union all select 'd' || subject_id, 'FLAG' from nums union all select 'p' || subject_id, verdict from links
      union all select 'c' || subject_id, 'BLOCK' from checked where status = 'hallucinated' union all select * from doc_links),
    subj as (select 'd' || doc_id as subject_id from documents union all select 'p' || page_id from pages union all select 'c' || p_partkey from part),
    g as (select subject_id, max(case verdict when 'BLOCK' then 2 else 1 end) as worst, avg(case verdict when 'BLOCK' then 0 else 0.5 end) as score, count(*) as n from claims group by subject_id)"""


@query("verify_outputs", _ALL_CLAIMS + """ select s.subject_id, case worst when 2 then 'BLOCK' when 1 then 'FLAG' else 'PASS' end as verdict, round(coalesce(score, 1.0), 9) as overall_score,
    coalesce(n, 0) as claims from subj s left join g using (subject_id)""")
def _(spark, d):
    out = claims.verify_outputs(_outputs(spark, d), "subject_id", "text", load(spark, d, "registry"), load(spark, d, "crawl"), "language")
    return out.withColumn("overall_score", F.round("overall_score", 9))


@query("claim_verdict_audit", _ALL_CLAIMS + """ select case when worst is null then 'PASS' else 'FLAG' end as verdict, count(*) as subjects from subj s left join g using (subject_id) group by 1""")
def _(spark, d):
    """Audit mode turns BLOCK into FLAG."""
    outputs = _outputs(spark, d)
    found = claims.output_claims(outputs, "subject_id", "text", load(spark, d, "registry"), load(spark, d, "crawl"), "language")
    return findings.claim_verdict(found, outputs, "audit").groupBy("verdict").agg(F.count(F.lit(1)).alias("subjects"))


@query("staged_pipeline", f"""with {ctes('snippets', 'registry', 'osv_flat')}, {_IMPORTS}, {_VULN},
    s1 as (select distinct subject_id from checked where status = 'hallucinated'), s2 as (select distinct subject_id from checked where status = 'valid')
    select p_partkey as subject_id, s1.subject_id is null as passed, case when s1.subject_id is not null then 'imports' end as blocked_at,
    case when s1.subject_id is not null then 2 when s2.subject_id is not null then 6 else 4 end as credits_used from part left join s1 on s1.subject_id = p_partkey left join s2 on s2.subject_id = p_partkey""")
def _(spark, d):
    code = load(spark, d, "snippets")
    subjects = code.select(F.col("part_id").alias("subject_id"))
    found = _imports(spark, d)
    registry, crawl = load(spark, d, "registry"), load(spark, d, "crawl")
    leak = findings.verdicts(secrets.secret_findings(code, "part_id", "code"), subjects, threshold="critical")
    fake = imports.package_existence(found, registry).where("status = 'hallucinated'").select("subject_id", F.lit("BLOCK").alias("verdict")).distinct()
    weak = imports.vulnerability_summary(found, _osv(spark, d)).select("subject_id", F.when(F.col("safe"), "PASS").otherwise("FLAG").alias("verdict"))
    valid = imports.package_existence(found, registry).where("status = 'valid'").select("subject_id")
    verified = claims.verify_outputs(code, "part_id", "code", registry, crawl, "language")
    return findings.staged_pipeline(subjects, [("secrets", leak, 1), ("imports", fake, 1), ("vulnerabilities", weak, 2, valid), ("verify", verified, 2)])


_CERT = "select doc_id, text, lang, case when n_chars > 500 then 'BLOCK' else 'PASS' end as verdict, doc_id % 5 as total_findings, 1700000000000 + doc_id as issued_ms from {documents}"


@query("attach_certificate", f"with s as ({plain(_CERT)}) select doc_id, verdict, 'sha256:' || sha256(sha256(text) || ':' || verdict || ':' || total_findings || ':' || issued_ms) as certificate from s")
def _(spark, d):
    from gatehouse.plans.inputs import run
    return findings.attach_certificate(run(spark, d, _CERT), "text").select("doc_id", "verdict", "certificate")


@query("verify_certificates", f"""with s as ({plain(_CERT)}) select doc_id, 'PASS' as verdict, 'sha256:' || sha256(sha256(text) || ':' || verdict || ':' || total_findings || ':' || issued_ms) as certificate
    from s where verdict = 'BLOCK' and doc_id % 4 = 0""")
def _(spark, d):
    """A quarter of the BLOCK verdicts is rewritten after signing; exactly those must be reported."""
    from gatehouse.plans.inputs import run
    signed = findings.attach_certificate(run(spark, d, _CERT), "text")
    forged = signed.withColumn("verdict", F.when(F.col("doc_id") % 4 == 0, "PASS").otherwise(F.col("verdict")))
    return findings.verify_certificates(forged, "text").select("doc_id", "verdict", "certificate")


@query("claim_certificates", f"with s as ({plain(_CERT)}) select doc_id, 'sha256:' || sha256(text || '|' || verdict || '|' || issued_ms) as certificate from s")
def _(spark, d):
    from gatehouse.plans.inputs import run
    return findings.attach_certificate(run(spark, d, _CERT), "text", form="claims").select("doc_id", "certificate")


@query("legal_citations", f"""with {ctes('citations')}, p as (select id, citation, citation not like 'see%' as ok, cast(regexp_extract(citation, '\\((\\d{{4}})\\)$', 1) as varchar) as y,
      regexp_extract(citation, '^\\d+ (.+) \\d+ \\(', 1) as abbr from citations)
    select id as subject_id, citation, case when ok then abbr end as reporter, case when not ok then 'malformed' else concat_ws(',', case when cast(y as int) not between 1754 and 2026 then 'implausible_year' end, case when abbr = 'Foo Rep.' then 'unknown_reporter' end) end as issues,
    case when not ok or cast(nullif(y, '') as int) not between 1754 and 2026 then 'BLOCK' when abbr = 'Foo Rep.' then 'FLAG' else 'PASS' end as verdict from p""".replace("{{", "{").replace("}}", "}"))
def _(spark, d):
    return legal.legal_citations(load(spark, d, "citations"), "id", "citation", reference.reporters(spark), 2026).select("subject_id", "citation", "reporter", "issues", "verdict")


@query("quote_fidelity", f"""with {ctes('quotes', 'sources')}, n as (select quote_id, source_id, trim(regexp_replace(lower(quote), '[\\s\\x{{a0}}]+', ' ', 'g')) as q, trim(regexp_replace(lower(source_text), '[\\s\\x{{a0}}]+', ' ', 'g')) as s
    from quotes left join sources using (source_id)), f as (select quote_id, source_id, case when s is not null then q <> '' and contains(s, q) end as found from n) select *, case when found then 'PASS' when not found then 'BLOCK' end as verdict from f""")
def _(spark, d):
    return legal.quote_fidelity(load(spark, d, "quotes"), load(spark, d, "sources"))


@query("quote_search", f"""with {ctes('quotes', 'sources')}, q as (select quote_id, trim(regexp_replace(lower(quote), '[\\s\\x{{a0}}]+', ' ', 'g')) as q from quotes),
    s as (select source_id, trim(regexp_replace(lower(source_text), '[\\s\\x{{a0}}]+', ' ', 'g')) as s from sources)
    select quote_id, source_id from q, s where q <> '' and contains(s, q)""")
def _(spark, d):
    return legal.quote_search(load(spark, d, "quotes"), load(spark, d, "sources"))


for _name in ("token_counts", "quote_fidelity", "quote_search"):
    ORACLE[_name] = ORACLE[_name].replace("{{", "{").replace("}}", "}")


@query("citation_verdicts", f"""with c as ({ORACLE['legal_citations']}), q as ({ORACLE['quote_fidelity']}),
    r as (select subject_id, case verdict when 'BLOCK' then 2 when 'FLAG' then 1 else 0 end as r from c union all select quote_id, case when found then 0 else 2 end from q where found is not null)
    select subject_id, case max(r) when 2 then 'BLOCK' when 1 then 'FLAG' else 'PASS' end as verdict from r group by subject_id""")
def _(spark, d):
    cited = legal.legal_citations(load(spark, d, "citations"), "id", "citation", reference.reporters(spark), 2026)
    quoted = legal.quote_fidelity(load(spark, d, "quotes"), load(spark, d, "sources")).select(F.col("quote_id").alias("subject_id"), "found")
    return legal.citation_verdicts(cited, quoted)
