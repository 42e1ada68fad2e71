"""Risky statements in a log of SQL text.

One alternation regex cuts a text into opaque tokens, so quotes and comments hide what is inside them.
The tokens are written back as one string with a class letter each (``W`` word, ``N`` number, ``S`` string,
``C`` comment, ``O`` operator …) and the rules are patterns over that string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatehouse.functions.bind import explode_rows
from gatehouse.operators.findings import as_findings

SEP = "\x1e"

# Words that count as keywords when the leading keyword of a statement is looked for.
KEYWORDS = """SELECT FROM WHERE AND OR NOT NULL IS IN LIKE BETWEEN EXISTS CASE WHEN THEN ELSE END JOIN LEFT RIGHT INNER OUTER
CROSS FULL ON GROUP BY ORDER HAVING LIMIT OFFSET TOP FETCH NEXT ROWS ONLY INSERT INTO VALUES UPDATE SET DELETE MERGE CREATE
ALTER DROP TRUNCATE RENAME TABLE VIEW INDEX SCHEMA DATABASE SEQUENCE GRANT REVOKE DENY USER ROLE PROCEDURE FUNCTION TRIGGER
UNION ALL INTERSECT EXCEPT DISTINCT AS WITH RECURSIVE TRUE FALSE PRIMARY KEY FOREIGN REFERENCES UNIQUE CHECK DEFAULT
CONSTRAINT COLUMN ADD IF EXEC EXECUTE CALL BEGIN COMMIT ROLLBACK TRANSACTION RETURNING OUTPUT USING OVER PARTITION ROW RANGE
CURRENT PRECEDING FOLLOWING UNBOUNDED WINDOW""".split()

# Possessive loops: a long literal must not recurse in the regex engine.
_TOKEN = "|".join([
    r"--[^\n]*+",
    r"/\*[^*]*+(?:\*(?!/)[^*]*+)*+(?:\*/)?",
    r"'[^']*+(?:''[^']*+)*+'?",
    r'"(?:[^"\\]++|\\.)*+"?',
    r"`[^`]*+`?",
    r"\$[0-9]++",
    r"\$([A-Za-z0-9_]*+)\$.*?(?:\$\1\$|\z)",
    r":[A-Za-z_][A-Za-z0-9_]*+",
    r"0[xX][0-9a-fA-F]*+",
    r"[0-9][0-9.]*+(?:[eE][+-]?[0-9]*+)?",
    r"[A-Za-z_][A-Za-z0-9_]*+",
    r"!=|<=|>=|<>|\|\||::",
    r"[^ \t\n\r\f]",
])
TOKEN = f"(?s)(?:{_TOKEN})"


def _classify(t: Column) -> Column:
    return (
        F.when(t.startswith("--") | t.startswith("/*"), F.lit("C"))
        .when(t.startswith("'"), F.concat(F.lit("S"), t))
        .when(t.rlike(r"\A\$[A-Za-z0-9_]*\$"), F.concat(F.lit("S"), t))
        .when(t.rlike("\\A[\"`]"), F.concat(F.lit("I"), t))
        .when(t.rlike(r"\A(?:\$[0-9]|:[A-Za-z_]|\?)"), F.concat(F.lit("P"), t))
        .when(t.rlike(r"\A[0-9]"), F.concat(F.lit("N"), F.upper(t)))
        .when(t.rlike(r"\A[A-Za-z_]"), F.concat(F.lit("W"), F.upper(t)))
        .otherwise(F.concat(F.lit("O"), t))
    )


def statements(sql: Column) -> Column:
    """Array of canonical statements that hold more than comments."""
    tokens = F.transform(F.regexp_extract_all(F.translate(sql, SEP, " "), F.lit(TOKEN), F.lit(0)), _classify)
    line = F.concat(F.lit(SEP), F.array_join(tokens, SEP), F.lit(SEP))
    parts = F.transform(F.split(line, f"{SEP}O;(?={SEP})"), lambda s: F.regexp_replace(F.concat(s, F.lit(SEP)), f"{SEP}{{2,}}", SEP))
    return F.filter(parts, lambda s: s.rlike(f"{SEP}[^C{SEP}]"))


def _word(*words: str) -> str:
    return f"{SEP}W(?:{'|'.join(words)}){SEP}"


def select_star(clean: Column) -> Column:
    """A bare ``*`` in a select list: bracketed parts without a SELECT are folded away first, inside out.

    Each round folds the innermost brackets of the statement; there are as many rounds as it has opening ones.
    """
    inner = rf"{SEP}O\((?:{SEP}(?!WSELECT{SEP}|O[()]{SEP})[^{SEP}]*+)*+{SEP}O\)(?={SEP})"
    opened = F.regexp_count(clean, F.lit(rf"{SEP}O\((?={SEP})"))
    rounds = F.when(opened > 0, F.sequence(F.lit(1), opened)).otherwise(F.array().cast("array<int>"))
    folded = F.aggregate(rounds, clean, lambda s, _: F.regexp_replace(s, inner, f"{SEP}X"))
    return folded.rlike(rf"{SEP}WSELECT(?:{SEP}(?!WSELECT{SEP}|WFROM{SEP}|O[()*]{SEP})[^{SEP}]*+)*+{SEP}O\*{SEP}")


def _finding(when: Column, rule: str, severity: str, message: str) -> Column:
    return F.when(when, F.struct(F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"), F.lit(message).alias("message")))


def sql_log_findings(df: DataFrame, id_col: str, sql_col: str, max_statements: int = 1, allow_unbounded_writes: bool = False,
                     allow_ddl: bool = False, evidence: int | None = None) -> DataFrame:
    """``evidence`` cuts the shown statement to so many characters; by default it is whole."""
    base = df.select(F.col(id_col).alias("subject_id"), statements(F.col(sql_col)).alias("stmts"))
    per = explode_rows(base, ["subject_id", F.size("stmts").alias("n_statements")], F.col("stmts"), "st", "position")
    # Bound once per statement: the text without comments and its leading keyword.
    per = per.withColumn("clean", F.regexp_replace("st", f"{SEP}C(?={SEP})", "")).withColumn(
        "kw", F.regexp_extract("clean", f"{SEP}W({'|'.join(KEYWORDS)}){SEP}", 1))
    clean, kw = F.col("clean"), F.col("kw")
    tautology = (clean.rlike(rf"{SEP}N([^{SEP}]*+){SEP}O={SEP}N\1{SEP}") | clean.rlike(rf"{SEP}S([^{SEP}]*+){SEP}O={SEP}S\1{SEP}")
                 | clean.contains(f"{SEP}WOR{SEP}WTRUE{SEP}"))
    tail = F.regexp_replace("st", rf"\A(?:{SEP}C(?={SEP}))+", "").contains(f"{SEP}C{SEP}")
    ddl = kw.isin("ALTER", "CREATE") if not allow_ddl else F.lit(False)
    unbounded = kw.isin("DELETE", "UPDATE") & ~clean.rlike(_word("WHERE")) if not allow_unbounded_writes else F.lit(False)
    rules = F.array(
        _finding((F.col("n_statements") > max_statements) & (F.col("position") == max_statements), "SQL-STACKED", "high", "more statements than allowed"),
        _finding(kw == "DROP", "SQL-DROP", "critical", "DROP statement"),
        _finding(kw == "TRUNCATE", "SQL-TRUNCATE", "critical", "TRUNCATE statement"),
        _finding(unbounded, "SQL-UNBOUNDED-WRITE", "critical", "write without WHERE"),
        _finding(kw.isin("GRANT", "REVOKE") | ddl, "SQL-GRANT-ALTER", "high", "privilege or schema change"),
        _finding(tautology, "SQL-ALWAYS-TRUE", "high", "condition that is always true"),
        _finding(clean.rlike(rf"{SEP}WUNION(?:{SEP}WALL)?{SEP}WSELECT{SEP}"), "SQL-UNION-INJECTION", "high", "UNION SELECT"),
        _finding(tail, "SQL-COMMENT-TAIL", "medium", "comment after statement text"),
        _finding((kw == "SELECT") & ~clean.rlike(_word("WHERE", "LIMIT", "TOP", "FETCH")) & select_star(clean),
                 "SQL-SELECT-STAR-NO-LIMIT", "low", "SELECT * without WHERE or LIMIT"),
    )
    whole = F.trim(F.regexp_replace("st", f"{SEP}[A-Z]?", " "))
    shown = (whole if evidence is None else F.substring(whole, 1, evidence)).alias("matched")
    hits = explode_rows(per, ["subject_id", "position", shown], F.filter(rules, lambda r: r.isNotNull()), "f")
    return as_findings(hits.select("subject_id", "position", "matched", "f.*").withColumn("category", F.lit("SQL")), "sql")
