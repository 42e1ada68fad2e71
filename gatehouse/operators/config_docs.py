"""Audits of configuration documents stored as JSON text: plans, access policies, workload manifests.

Each document is parsed once to VARIANT, its parts are exploded, and the rules are type-strict tests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatehouse.functions.bind import explode_rows
from gatehouse.functions.variants import at, doc, items, kind, string, text
from gatehouse.operators.findings import as_findings, dedupe_findings

# Resource types that hold state, public access lists, workload kinds with a pod template.
STATEFUL_TYPES = """aws_db_instance aws_rds_cluster aws_rds_cluster_instance aws_ebs_volume aws_s3_bucket aws_dynamodb_table
aws_elasticache_cluster aws_elasticsearch_domain aws_opensearch_domain aws_redshift_cluster aws_efs_file_system
aws_fsx_lustre_file_system aws_fsx_windows_file_system""".split()
PUBLIC_ACLS = ["public-read", "public-read-write"]
TEMPLATE_KINDS = ["Deployment", "DaemonSet", "StatefulSet", "ReplicaSet", "Job"]


def _finding(when: Column, rule: str, severity: str, message: str) -> Column:
    return F.when(when, F.struct(F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"), F.lit(message).alias("message")))


def _emit(parts: DataFrame, tool: str, rules: list[Column]) -> DataFrame:
    hits = explode_rows(parts, ["subject_id", "position", F.col("resource").alias("matched")], F.filter(F.array(*rules), lambda r: r.isNotNull()), "f")
    found = as_findings(hits.select("subject_id", "position", "matched", "f.*").withColumn("category", F.lit("CONFIG")), tool)
    return dedupe_findings(found, ["subject_id", "rule_id", "matched"])


def _documents(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    return df.select(F.col(id_col).alias("subject_id"), doc(F.col(json_col)).alias("d"))


def _has(array: Column, value: str) -> Column:
    return F.exists(array, lambda x: text(x) == f'"{value}"')


def _strings(v: Column) -> Column:
    """A string or an array as an array of its strings."""
    return F.when(kind(v) == "string", F.array(v)).otherwise(items(v))


def terraform_findings(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    changes = explode_rows(_documents(df, id_col, json_col), ["subject_id"], items(at(F.col("d"), "$.resource_changes")), "rc", "position")
    rc = F.col("rc")
    parts = changes.select(
        "subject_id", "position", F.coalesce(string(at(rc, "$.address")), F.lit("unknown")).alias("resource"),
        string(at(rc, "$.type")).alias("type"), items(at(rc, "$.change.actions")).alias("actions"),
        at(rc, "$.change").alias("change"), at(rc, "$.change.after").alias("after")).where(kind(F.col("change")) == "object")
    after = F.col("after")
    kind_is = lambda *t: F.col("type").isin(*t)
    is_open = lambda v: _has(items(at(v, "$.cidr_blocks")), "0.0.0.0/0") | _has(items(at(v, "$.ipv6_cidr_blocks")), "::/0")
    group = kind_is("aws_security_group") & F.exists(items(at(after, "$.ingress")), is_open)
    rule = kind_is("aws_security_group_rule") & (text(at(after, "$.type")) == '"ingress"') & is_open(after)
    return _emit(parts, "terraform", [
        _finding(kind_is(*STATEFUL_TYPES) & _has(F.col("actions"), "delete"), "TF-CHG-001", "high", "stateful resource destroyed or replaced"),
        _finding(group | rule, "TF-SEC-001", "high", "ingress open to the world"),
        _finding(kind_is("aws_s3_bucket", "aws_s3_bucket_acl") & string(at(after, "$.acl")).isin(PUBLIC_ACLS), "TF-SEC-002", "critical", "public bucket access list"),
        _finding(kind_is("aws_db_instance") & (text(at(after, "$.publicly_accessible")) == "true"), "TF-SEC-003", "critical", "database publicly accessible"),
        _finding((kind_is("aws_db_instance") & (text(at(after, "$.storage_encrypted")) == "false"))
                 | (kind_is("aws_ebs_volume") & (text(at(after, "$.encrypted")) == "false")), "TF-SEC-004", "medium", "storage not encrypted"),
    ])


def iam_findings(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    stmts = explode_rows(_documents(df, id_col, json_col), ["subject_id"], items(at(F.col("d"), "$.Statement")), "s", "position").where(
        kind(F.col("s")) == "object")
    s = F.col("s")
    parts = stmts.select(
        "subject_id", "position", "s",
        F.concat(F.lit("Statement:"), F.coalesce(string(at(s, "$.Sid")), F.concat(F.lit("Statement["), F.col("position"), F.lit("]")))).alias("resource"),
        F.coalesce(string(at(s, "$.Effect")), F.lit("Allow")).alias("effect"),
        _strings(at(s, "$.Action")).alias("actions"), _strings(at(s, "$.Resource")).alias("resources"))
    allow = F.col("effect") == "Allow"
    star = lambda v: F.coalesce(text(v) == '"*"', F.lit(False))
    principal = star(at(s, "$.Principal")) | star(at(s, "$.Principal.AWS")) | _has(items(at(s, "$.Principal.AWS")), "*") | star(at(s, "$.Principal.Federated"))
    return _emit(parts, "iam", [
        _finding(_has(F.col("actions"), "*"), "IAM-WILDCARD-ACTION", "critical", "every action"),
        _finding(allow & _has(F.col("resources"), "*"), "IAM-WILDCARD-RESOURCE", "high", "every resource"),
        _finding(allow & at(s, "$.NotAction").isNotNull(), "IAM-NOTACTION", "high", "allow with NotAction"),
        _finding(principal, "IAM-WILDCARD-PRINCIPAL", "critical", "any principal"),
        _finding(allow & _has(F.col("actions"), "iam:PassRole") & _has(F.col("resources"), "*"), "IAM-PASSROLE-STAR", "high", "PassRole on every resource"),
    ])


def _unpinned(image: Column) -> Column:
    last = F.substring_index(image, "/", -1)
    tag = F.substring_index(last, ":", -1)
    return (image != "") & ~image.contains("@sha256:") & (~last.contains(":") | tag.isin("", "latest"))


def k8s_findings(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    d = F.col("d")
    parsed = _documents(df, id_col, json_col)
    # A list may hold lists: opened as often as the text names items at all, which is no less than their depth.
    listed = lambda v: F.coalesce(string(at(v, "$.kind")), F.lit("")).isin("List", "")
    times = F.regexp_count(F.to_json("d"), F.lit('"items"'))
    rounds = F.when(times > 0, F.sequence(F.lit(1), times)).otherwise(F.array().cast("array<int>"))
    opened = F.aggregate(rounds, F.array("d"), lambda vs, _: F.flatten(F.transform(vs, lambda v: F.when(listed(v), items(at(v, "$.items"))).otherwise(F.array(v)))))
    parsed = explode_rows(parsed, ["subject_id"], F.filter(opened, lambda v: ~listed(v)), "d")
    named = parsed.withColumn("kind", string(at(d, "$.kind"))).withColumn("name", F.coalesce(string(at(d, "$.metadata.name")), F.lit("unknown")))
    spec = (
        F.when(F.col("kind") == "Pod", at(d, "$.spec")).when(F.col("kind").isin(TEMPLATE_KINDS), at(d, "$.spec.template.spec"))
        .when(F.col("kind") == "CronJob", at(d, "$.spec.jobTemplate.spec.template.spec"))
    )
    pods = named.select("subject_id", F.lit(0).alias("position"), F.concat_ws("/", "kind", "name").alias("pod"), spec.alias("spec")).where(
        kind(F.col("spec")) == "object")
    true_at = lambda v, path: F.coalesce(text(at(v, path)) == "true", F.lit(False))
    sp = F.col("spec")
    pod_level = _emit(pods.withColumn("resource", F.col("pod")), "k8s", [
        _finding(true_at(sp, "$.hostNetwork"), "K8S-HOST-NETWORK", "high", "host network"),
        _finding(true_at(sp, "$.hostPID"), "K8S-HOST-PID", "high", "host process ids"),
        _finding(true_at(sp, "$.hostIPC"), "K8S-HOST-IPC", "high", "host IPC"),
    ])
    vol = F.col("v")
    volumes = explode_rows(pods, ["subject_id", "pod"], items(at(sp, "$.volumes")), "v", "position").withColumn(
        "resource", F.concat("pod", F.lit("/volume:"), F.coalesce(string(at(vol, "$.name")), F.lit("unknown"))))
    volume_level = _emit(volumes, "k8s", [_finding(at(vol, "$.hostPath").isNotNull(), "K8S-HOST-PATH", "medium", "host path mounted")])
    c = F.col("c")
    boxes = explode_rows(pods, ["subject_id", "pod"], F.concat(items(at(sp, "$.containers")), items(at(sp, "$.initContainers"))), "c", "position").where(
        kind(c) == "object").withColumn("resource", F.concat("pod", F.lit("/container:"), F.coalesce(string(at(c, "$.name")), F.lit("unknown"))))
    caps = items(at(c, "$.securityContext.capabilities.add"))
    container_level = _emit(boxes, "k8s", [
        _finding(_unpinned(F.coalesce(string(at(c, "$.image")), F.lit(""))), "K8S-LATEST-TAG", "medium", "image not pinned"),
        _finding(~F.coalesce(kind(at(c, "$.resources.limits")) == "object", F.lit(False)), "K8S-NO-RESOURCE-LIMITS", "low", "no resource limits"),
        _finding(true_at(c, "$.securityContext.privileged"), "K8S-PRIVILEGED", "critical", "privileged container"),
        _finding(text(at(c, "$.securityContext.runAsNonRoot")) == "false", "K8S-RUN-AS-NON-ROOT", "high", "may run as root"),
        _finding(true_at(c, "$.securityContext.allowPrivilegeEscalation"), "K8S-PRIVILEGE-ESCALATION", "high", "privilege escalation allowed"),
        _finding(_has(caps, "SYS_ADMIN") | _has(caps, "ALL"), "K8S-SYS-ADMIN", "critical", "administrative capabilities"),
    ])
    return pod_level.unionByName(volume_level).unionByName(container_level)
