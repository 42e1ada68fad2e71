"""Destructive or exfiltrating commands in a shell log.

Tokens come from one alternation regex, so quoted text is opaque.  A command becomes an array of segments
(cut at ``;``, ``&&``, ``||``, ``|`` and newlines); a segment is one string of class-tagged tokens: ``W`` word,
``Q`` quoted, ``R`` redirect, ``V`` variable, ``B`` substitution.  Neighbouring segments meet inside the
row, so pipe rules need no window and no shuffle.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatehouse.functions.bind import explode_rows
from gatehouse.operators.findings import as_findings

SEP = "\x1e"
_WORD = r"(?:\\.|[^ \t\r\n'\"\\$`&|;<>]|&(?!&)|\$(?![({A-Za-z_]))++"
_TOKEN = "|".join([
    r"'[^']*+'?",
    r'"(?:[^"\\]++|\\.)*+"?',
    r"\$\((?:[^()'\"]++|'[^']*+'?|\"(?:[^\"\\]++|\\.)*+\"?)*+\)?",
    r"\$\{[^}]*+\}?",
    r"\$[A-Za-z_][A-Za-z0-9_]*+",
    r"`(?:[^`\\]++|\\.)*+`?",
    r"&&|\|\||\||;|\n",
    r">>|>|<",
    _WORD,
])
TOKEN = f"(?s)(?:{_TOKEN})"
# Stand for brackets inside a substitution while tokens are cut.
_OPEN, _SHUT = "\x1c", "\x1d"
_LEXEME = r"(?s)\$\(|\\.|'[^']*+'?|\"(?:[^\"\\]++|\\.)*+\"?|`(?:[^`\\]++|\\.)*+`?|[()]|[^'\"`()$\\]++|."

# Command groups the rules name.
SHELLS = "sh|bash|zsh|dash|ksh|fish|ash"
DOWNLOADERS = ["curl", "wget", "fetch", "ftp"]
SECRET_NAME = r"(?i)\A(.*_)?(KEY|TOKEN|SECRET|PASSWORD|PASSWD|PASS|APIKEY|API_KEY)(_.*)?\z"


def _classify(t: Column) -> Column:
    return (
        F.when(t.isin("&&", "||", "|", ";", "\n"), F.lit("X"))
        .when(t.rlike("\\A['\"]"), F.concat(F.lit("Q"), t))
        .when(t.isin(">", ">>", "<"), F.concat(F.lit("R"), t))
        .when(t.rlike(r"\A(?:\$\(|`)"), F.concat(F.lit("B"), t))
        .when(t.rlike(r"\A\$[{A-Za-z_]"), F.concat(F.lit("V"), t))
        .otherwise(F.concat(F.lit("W"), t))
    )


def _mask_inner(flat: Column) -> Column:
    """Brackets inside ``$( … )`` become stand-ins, at any depth, so that the outer pair is the only one left."""
    def step(state: Column, t: Column) -> Column:
        depth = state["depth"]
        opens, shuts = F.endswith(t, F.lit("(")) & (F.length(t) <= 2), t.isin(")", "\\)")
        starts = (depth == 0) & (t == "$(")
        after = F.when(starts | ((depth > 0) & opens), depth + 1).when((depth > 0) & shuts, depth - 1).otherwise(depth)
        text = F.when((depth > 0) & opens, F.translate(t, "(", _OPEN)).when((after > 0) & shuts, F.translate(t, ")", _SHUT)).otherwise(t)
        return F.struct(F.concat(state["text"], text).alias("text"), after.alias("depth"))

    lexemes = F.regexp_extract_all(flat, F.lit(_LEXEME), F.lit(0))
    folded = F.aggregate(lexemes, F.struct(F.lit("").alias("text"), F.lit(0).alias("depth")), step)["text"]
    return F.when(F.contains(flat, F.lit("$(")), folded).otherwise(flat)


def segments(command: Column) -> Column:
    flat = F.translate(F.regexp_replace(command, "\\\\\n", ""), SEP + _OPEN + _SHUT, "   ")
    cut = F.regexp_extract_all(_mask_inner(flat), F.lit(TOKEN), F.lit(0))
    tokens = F.transform(cut, lambda t: _classify(F.translate(t, _OPEN + _SHUT, "()")))
    line = F.concat(F.lit(SEP), F.array_join(tokens, SEP), F.lit(SEP))
    parts = F.transform(F.split(line, f"{SEP}X(?={SEP})"), lambda s: F.regexp_replace(F.concat(s, F.lit(SEP)), f"{SEP}{{2,}}", SEP))
    return F.filter(parts, lambda s: F.length(s) > 1)


def _first_word(seg: Column) -> Column:
    return F.lower(F.regexp_extract(seg, f"{SEP}W([^{SEP}]*)", 1))


def with_segments(df: DataFrame, id_col: str, command_col: str) -> DataFrame:
    """``subject_id, position, seg, fw`` and the neighbour's ``nseg, nfw``; one row per segment."""
    base = df.select(F.col(id_col).alias("subject_id"), segments(F.col(command_col)).alias("segs"))
    pairs = F.transform("segs", lambda s, i: F.struct(i.alias("position"), s.alias("seg"), F.get("segs", i + 1).alias("nseg")))
    paired = explode_rows(base, ["subject_id", F.size("segs").alias("n_segments")], pairs, "x")
    return paired.select("subject_id", "n_segments", "x.*").withColumn("fw", _first_word(F.col("seg"))).withColumn("nfw", _first_word(F.col("nseg")))


def _has(*words: str, seg: str = "seg") -> Column:
    """Any of the words (patterns) as a whole word, in any case."""
    return F.col(seg).rlike(f"(?i){SEP}W(?:{'|'.join(words)}){SEP}")


def _finding(when: Column, rule: str, severity: str, message: str) -> Column:
    return F.when(when, F.struct(F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"), F.lit(message).alias("message")))


def _findings(segs: DataFrame, rules: list[Column], allow: list[str]) -> DataFrame:
    shown = F.trim(F.regexp_replace("seg", f"{SEP}[A-Z]?", " ")).alias("matched")
    found = F.filter(F.array(*rules), lambda r: r.isNotNull())
    hits = explode_rows(segs, ["subject_id", "position", shown], found, "f").select("subject_id", "position", "matched", "f.*")
    if allow:
        hits = hits.where(~F.col("rule_id").isin(allow))
    return as_findings(hits.withColumn("category", F.lit("CMD")), "command")


def command_log_findings(df: DataFrame, id_col: str, command_col: str, protected_refs: list[str] | None = None,
                         allow: list[str] | None = None) -> DataFrame:
    """The fifteen rules that look at one segment."""
    segs = with_segments(df, id_col, command_col)
    seg, fw = F.col("seg"), F.col("fw")
    refs = "|".join(re.escape(r) for r in (protected_refs or ["main", "master"]))
    flag = lambda letters: seg.rlike(f"(?i){SEP}W-[a-z]*[{letters}]")
    to = lambda target: seg.rlike(f"{SEP}R>{SEP}W{target}")

    rm_root = (fw == "rm") & (flag("rf") | _has("--recursive", "--force")) & (
        _has("/", r"/\*", "~", "~/", r"\.") | seg.rlike(rf"(?i){SEP}V\$\{{?(?:HOME|PWD)\}}?{SEP}"))
    disk = (((fw == "dd") & seg.rlike(f"(?i){SEP}Wof=/dev/")) | fw.startswith("mkfs") | (fw == "mkswap")
            | to("(?i:/dev/(?:sd[a-z]|disk|nvme|vd[a-z]|hd[a-z]))"))
    bomb = seg.rlike(rf":(?:{SEP}W)?\((?:{SEP}W)?\)(?:{SEP}W)?\{{") | seg.rlike(rf"\(\)[\s{SEP}W]*\{{[^}}]*\|[^}}]*&")
    chmod = (fw == "chmod") & (_has("0?[0-7][0-7][2367]") | seg.rlike(rf"(?i){SEP}W(?:a\+[^{SEP}]*w|o\+[^{SEP}]*w|ugo\+[^{SEP}]*w|a\+rwx)"))
    chown = (fw == "chown") & (_has("root(?:[:.]root)?", "0(?:[:.]0)?") | (
        (flag("r") | _has("--recursive")) & seg.rlike(rf"(?i){SEP}W/(?:etc|usr|bin|sbin|lib|lib64|boot|sys|proc)(?:/|{SEP})")))
    escalate = fw.isin("sudo", "doas") | ((fw == "su") & _has("-", "-l", "--login", "root", "-s"))
    push = (fw == "git") & _has("push") & _has("--force", "-f", "--force-with-lease", "--force-if-includes") & seg.rlike(
        rf"(?i){SEP}W(?!-)(?:[^{SEP}]*[/:])?(?:{refs}){SEP}")
    k8s = (((fw == "kubectl") & _has("delete")) | ((fw == "helm") & _has("uninstall", "delete", "destroy"))
           | ((fw == "docker") & ((_has("system") & _has("prune")) | (_has("volume") & _has("rm"))))
           | (fw.isin("terraform", "tofu") & _has("destroy")))
    security = ((fw.isin("iptables", "ip6tables") & _has("-f", "--flush", "-x", "-z")) | ((fw == "ufw") & _has("disable", "reset"))
                | ((fw == "setenforce") & _has("0", "permissive")) | ((fw == "csrutil") & _has("disable"))
                | ((fw == "systemctl") & _has("stop", "disable", "mask") & _has("firewalld", "ufw", "iptables", "nftables", "apparmor", "auditd"))
                | ((fw == "apparmor_parser") & _has("-r", "--remove")) | (fw == "aa-disable"))
    history = (((fw == "history") & (_has("-c") | (_has("-w") & _has("/dev/null"))))
               | ((fw == "rm") & seg.rlike(rf"(?i){SEP}W[^{SEP}]*\.(?:ba|z|fi|k)?sh_history{SEP}"))
               | ((fw == "unset") & (_has("histfile", "histsize", "savehist") | seg.rlike(rf"(?i){SEP}V\$\{{?(?:HISTFILE|HISTSIZE|SAVEHIST)\}}?{SEP}")))
               | to(rf"[^{SEP}]*\.(?:ba|z|fi|k|c)?sh_history{SEP}") | ((fw == "export") & seg.rlike(f"(?i){SEP}Whistfile=")))
    power = fw.isin("shutdown", "reboot", "halt", "poweroff") | ((fw == "init") & _has("0", "6"))
    kill = (((fw == "kill") & _has("-9", "-sigkill", "sigkill", "-kill") & _has("-1")) | (fw.isin("killall", "pkill") & _has("-9", "-sigkill")))
    insecure = (fw.isin("curl", "curl.exe") & _has("-k", "--insecure")) | (fw.isin("wget", "wget2") & _has("--no-check-certificate"))
    crontab = (((fw == "crontab") & (_has("-r") | seg.rlike(f"(?i){SEP}W(?!-)(?!crontab{SEP})"))) | to(f"[^{SEP}]*(?i:/etc/cron)"))
    names = F.transform(F.regexp_extract_all(seg, F.lit(rf"{SEP}V\$\{{?([^{SEP}}}]*)\}}?"), F.lit(1)), lambda n: n.rlike(SECRET_NAME))
    echo = fw.isin("echo", "printf", "print") & F.array_contains(names, True)

    return _findings(segs, [
        _finding(rm_root, "CMD-RM-RECURSIVE-ROOT", "critical", "recursive removal of a root or home directory"),
        _finding(disk, "CMD-DISK-WRITE-RAW", "critical", "raw write to a block device"),
        _finding(bomb, "CMD-FORK-BOMB", "critical", "fork bomb"),
        _finding(chmod, "CMD-CHMOD-WORLD-WRITABLE", "high", "world-writable permissions"),
        _finding(chown, "CMD-CHOWN-ROOT", "high", "ownership change to root or on a system path"),
        _finding(escalate, "CMD-PRIVILEGE-ESCALATION", "high", "privilege escalation"),
        _finding(push, "CMD-GIT-FORCE-PUSH-PROTECTED", "high", "force push to a protected branch"),
        _finding(k8s, "CMD-K8S-DESTROY", "high", "removal of managed resources"),
        _finding(security, "CMD-SECURITY-DISABLE", "high", "security service disabled"),
        _finding(history, "CMD-HISTORY-WIPE", "medium", "shell history removed"),
        _finding(power, "CMD-SHUTDOWN-REBOOT", "medium", "power state change"),
        _finding(kill, "CMD-KILL-ALL", "medium", "kill of many processes"),
        _finding(insecure, "CMD-CURL-INSECURE", "medium", "certificate check disabled"),
        _finding(crontab, "CMD-CRONTAB-OVERWRITE", "medium", "crontab replaced"),
        _finding(echo, "CMD-ENV-SECRET-ECHO", "low", "secret variable printed"),
    ], allow or [])


def command_chain_findings(df: DataFrame, id_col: str, command_col: str, max_segments: int = 50, allow: list[str] | None = None) -> DataFrame:
    """Rules over neighbouring segments and the segment limit (which no allow list lifts)."""
    segs = with_segments(df, id_col, command_col)
    seg, fw, nfw = F.col("seg"), F.col("fw"), F.col("nfw")
    remote = fw.isin(DOWNLOADERS) & (nfw.rlike(rf"\A(?:{SHELLS})\z") | (_has("sudo", seg="nseg") & _has(SHELLS, seg="nseg")))
    post = (fw.isin("curl", "curl.exe") & seg.rlike(f"{SEP}W@[^{SEP}]") & _has("-d", "--data", "--data-binary", "-f", "--form")
            & seg.rlike(f"{SEP}Whttps?://"))
    rules = [
        _finding(remote, "CMD-REMOTE-EXEC-PIPE", "critical", "download piped to a shell"),
        _finding(fw.isin("nc", "ncat", "netcat") & (F.col("position") > 0), "CMD-EXFIL", "high", "data piped to a network tool"),
        _finding(post, "CMD-EXFIL", "high", "local file posted"),
        _finding(fw.isin("base64", "openssl") & nfw.isin("curl", "wget", "nc", "ncat"), "CMD-EXFIL", "high", "encoded data piped to a network tool"),
    ]
    too_many = [_finding((F.col("n_segments") > max_segments) & (F.col("position") == max_segments), "CMD-TOO-MANY-SEGMENTS", "high", "too many segments")]
    return _findings(segs, rules, allow or []).unionByName(_findings(segs, too_many, []))
