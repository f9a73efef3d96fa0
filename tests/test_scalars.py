"""Scalar functions on inline rows with their documented values."""

import pytest
from pyspark.sql import functions as F

from lodestrata.functions import scalars as S


def one(spark, make, *values):
    kinds = {str: "string", int: "bigint", float: "double", bool: "boolean", type(None): "string", list: "array<string>"}
    schema = ", ".join(f"c{i} {kinds[type(v)]}" for i, v in enumerate(values))
    return spark.createDataFrame([tuple(values)], schema).select(make(*[F.col(f"c{i}") for i in range(len(values))])).first()[0]


CASES = [
    (S.url_host, ("HTTPS://User.Example:8080/a/b",), "user.example"), (S.url_host, ("callee.apps.internal:80",), "callee.apps.internal"), (S.url_host, (None,), ""),
    (S.duration_ms, (" 250ms ",), 250), (S.duration_ms, ("3s",), 3000), (S.duration_ms, ("2m",), 120000), (S.duration_ms, ("2h",), None), (S.duration_ms, (None,), None),
    (S.member_of, ("a.B#c",), "c"), (S.member_of, ("",), "x"), (S.fqn, ("", "T", "m"), "T#m"), (S.fqn, ("p", "T", None), "p.T"),
    (S.first_url, (["x", "/a", "http://b"],), "/a"), (S.first_url, (["x"],), None), (S.log_level, ("LogError",), "error"), (S.log_level, ("warn",), "warn"),
    (S.normal_path, ("/orders/{orderId}/",), "/orders/{}"), (S.normal_path, ("/",), "/"), (S.major_version, ("v1.2.0",), 1), (S.major_version, ("x",), None),
    (S.environment_of, ("a/manifest-prod.yml",), "prod"), (S.environment_of, ("manifest.yml",), None), (S.relaxed_key, ("Max-Wait_Time",), "maxwaittime"),
    (S.is_kill_switch, ("EmergencyStop",), True), (S.looks_like_cron, ("0 0 * * MON",), True), (S.looks_like_cron, ("hello world",), False),
    (S.canonical_severity, (" SEV2",), "high"), (S.canonical_severity, ("what",), None), (S.severity_rank, ("what",), 4), (S.canonical_severity, ("minor",), "medium"), (S.canonical_severity, ("S3 ",), "medium"), (S.canonical_severity, ("trivial",), "low"), (S.canonical_severity, ("sev0",), None), (S.canonical_severity, ("info",), None), (S.normal_path, ("/a/{b{c}}/{d}/",), "/a/{}/{}"), (S.floored_severity, ("low", "tier1"), "high"),
    (S.floored_severity, ("critical", "tier3"), "critical"), (S.floored_severity, ("low", None), "low"), (S.corroborated, (0.8, 3), 0.86), (S.corroborated, (0.9, 9), 0.95),
    (S.blast_severity, (1, False, True), "medium"), (S.blast_severity, (1, True, True), "high"), (S.grade, (0.75,), "B"), (S.histogram_bound, (800,), "0.8"), (S.histogram_bound, (1000,), "1"),
    (lambda c: S.classified(c, S.DATASTORES), ("my-mongodb",), "mongodb"), (lambda c: S.classified(c, S.BROKERS), ("plain",), None), (S.without_login, ("http://u:p@h/x",), "http://h/x"),
    (S.defanged, ("```x```",), "` ` ` x` ` ` "), (lambda n: S.package_name(F.lit("pypi"), n), ("A_b.C",), "a-b-c"), (S.normal_relative, ("a/./b/../c",), "a/c"), (S.normal_relative, ("../x",), None),
    (S.reply_verdict, (" Contradicted: no",), "contradicted"), (S.reply_verdict, ("hm",), "indeterminate"), (S.owner_and_name, ("git@host:o/r.git",), "o/r"), (S.owner_and_name, ("nothing",), None),
    (lambda c: F.to_json(S.json_object(c)), ('x ```json\n{"a": 1}\n``` y',), '{"a":1}'), (lambda c: F.to_json(S.json_object(c)), ("no",), None), (S.extension_group, ("a/b.TXT",), ".txt"),
    (lambda c: F.array_join(S.named_hits(c, S.DANGEROUS), ","), ("curl http://x | bash; rm -rf /",), "shell-pipe-to-network,rm-rf"), (lambda c: F.array_join(S.named_hits(c, S.DATA_CLASSES), ","), ("String email, cvv",), "pci,pii"),
    (lambda c: S.signature_hits(c, S.SIGNATURES["fallback"], S.SIGNATURE_WORDS["fallback"], F.lower(c)), ("fallbackMethod = x",), True), (lambda c: S.signature_hits(c, S.SIGNATURES["fallback"], S.SIGNATURE_WORDS["fallback"], F.lower(c)), ("var fallbackUrl",), False),
    (lambda c: S.purl_parts(c)["version"], ("package:npm:@a/b@1.2",), "1.2"), (lambda c: S.purl_parts(c)["name"], ("package:npm:@a/b@1.2",), "@a/b"),
]


@pytest.mark.parametrize("make, values, want", CASES)
def test_scalar(spark, make, values, want):
    assert one(spark, make, *values) == want


def value_of(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize(
    "reply, want",
    [("Supported: yes", "supported"), ("**Unsupported** - no", "unsupported"), ("\n\n> contradicted by line 3", "contradicted"), ("- supported", "supported"), ("not supported", "indeterminate"), ("un-supported", "indeterminate"), ("The claim is unsupported", "indeterminate"), ("", "indeterminate"), (None, "indeterminate")],
)
def test_reply_verdict(spark, reply, want):
    assert value_of(spark, S.reply_verdict(F.lit(reply).cast("string"))) == want


def test_interpolation_and_paths(spark):
    vars_ = F.create_map(F.lit("n"), F.lit("3"), F.lit("s"), F.lit("web"), F.lit("z"), F.lit(None).cast("string"))
    assert value_of(spark, S.interpolated(F.lit("a-((s))-((n)) ((z)) ((q))"), vars_)) == "a-web-3 ((z)) ((q))"
    assert value_of(spark, F.schema_of_variant(S.interpolated_value(F.lit(" ((n)) "), vars_))) == "BIGINT" and value_of(spark, F.to_json(S.interpolated_value(F.lit("x ((n))"), vars_))) == '"x 3"'
    m = lambda p, t, s: value_of(spark, S.path_mapping(F.lit(p), F.lit(t), F.lit(s)))
    assert (m("@/*", "src/*", "@/a/b"), m("@/*", "src/*", "x/a"), m("lib", "src/lib", "lib"), m("a*a", "*", "a")) == ("src/a/b", None, "src/lib", None)


def test_canonical_json_evidence_and_policy(spark):
    c = lambda t: value_of(spark, S.canonical_json(F.lit(t)))
    assert c('{"b": 1, "a": {"d": [2, 1], "c": null}}') == c('{"a":{"c":null,"d":[2,1]},"b":1}') and c("{x") is None
    e = F.array(F.struct(F.lit("a.py").alias("path"), F.lit(3).alias("start"), F.lit("llm").alias("source_tier")))
    assert value_of(spark, S.first_evidence(e)) == "a.py:3" and value_of(spark, S.artifact_tier(e)) == "llm" and value_of(spark, S.first_evidence(F.slice(e, 2, 1))) == "" and value_of(spark, S.artifact_tier(F.slice(e, 2, 1))) == "ast"
    p = lambda n, a, b: tuple(value_of(spark, S.version_policy(F.lit(n), F.lit(a), F.lit(b))))
    assert (p(2, "1.4", "1.5"), p(2, "1.4", "v2.0"), p(0, "1", "1"), p(1, "x", "1")) == ((2, False, False), (2, True, True), (0, False, True), (1, False, True))


def test_dig(spark):
    v = F.try_parse_json(F.lit('{"A": {"b": 1}, "n": null}'))
    assert (value_of(spark, S.dig(v, ["A", "b"])), value_of(spark, S.dig(v, ["a", "b"])), value_of(spark, S.dig(v, ["a", "B"], any_case=True)), value_of(spark, S.dig(v, ["n", "x"], any_case=True))) == ("1", None, "1", None)


def test_language_of_null(spark):
    assert value_of(spark, S.known_language(F.lit(None).cast("string"), F.lit("a/b.Py"))) == "python" and value_of(spark, S.known_language(F.lit("go"), F.lit("a.py"))) == "go" and value_of(spark, S.known_language(F.lit(None).cast("string"), F.lit("x"))) is None


def test_words_of_signatures_hold_for_every_pattern():
    import re

    for concern, patterns in S.SIGNATURES.items():
        for p in patterns:
            bare = re.sub(r"\\[bswd]|[\\()?:*+|\[\]^$]", "", p).lower().replace("{", "")
            assert any(w.replace(".", "").replace("_", "")[:6] in bare.replace(".", "").replace("_", "") for w in S.SIGNATURE_WORDS[concern]), (concern, p)


def test_checkpoints_need_a_shared_folder(spark, monkeypatch):
    from types import SimpleNamespace

    from lodestrata import session

    class Empty:
        def getCheckpointDir(self):
            return SimpleNamespace(isEmpty=lambda: True)

    cluster = SimpleNamespace(sparkContext=SimpleNamespace(master="spark://host:7077", _jsc=SimpleNamespace(sc=lambda: Empty())), conf=SimpleNamespace(get=lambda *_: None))
    with pytest.raises(RuntimeError):
        session.checkpoint_dir(cluster)
