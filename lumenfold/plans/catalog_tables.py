"""Registered queries over the ledger's side tables, derived from whole given tables, and over
sample files, nested JSON and both streams of a tool."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import json_walk, redaction
from ..operators import ledger
from ..sources import derived as d
from ..sources import schemas
from ..sources.derived import sql
from ..sources.scratch import scratch_path
from .catalog import _SECRETS, query

_ENV_KEYS = """SELECT s.server_id, array_to_string(list_sort(list(DISTINCT b.env_key) FILTER (b.env_key IS NOT NULL)), ',') AS env_keys, count(b.binding_id) > 0 AS bound
 FROM server_profiles s LEFT JOIN part_bindings b USING (server_id) GROUP BY s.server_id"""


@query(sql(_ENV_KEYS, "server_profiles", "part_bindings"))
def p9_env_keys(spark: SparkSession, sf: str) -> DataFrame:
    """The environment keys that the bindings of each server ask for, of a server for each supplier."""
    got = ledger.requested_env_keys(d.server_profiles(spark, sf), d.part_bindings(spark, sf))
    return got.select("server_id", F.when(F.size("env_keys") > 0, F.array_join("env_keys", ",")).alias("env_keys"), F.col("env_keys").isNotNull().alias("bound"))


@query(sql("""SELECT t.server_id, t.tool_name, b.binding_id, b.env_key FROM tool_descriptors t
 JOIN part_bindings b ON b.server_id = t.server_id AND (b.tool_name = t.tool_name OR b.tool_name = '*') WHERE b.injection_method = 'ChildEnv' AND b.rare""", "tool_descriptors", "part_bindings"))  # fmt: skip
def p8_bindings_of_tools(spark: SparkSession, sf: str) -> DataFrame:
    """Bindings of each tool, a tool for each part; bindings of all tools for a few parts only."""
    tools = d.tool_descriptors(spark, sf).select("server_id", "tool_name")
    return ledger.resolve_bindings(tools, d.part_bindings(spark, sf).filter("rare")).select("server_id", "tool_name", "binding_id", "env_key")


@query(sql("""SELECT 'outbox' AS lookup, status AS value FROM outbox_items WHERE outbox_id = 32 UNION ALL SELECT 'kind', kind FROM outbox_items WHERE outbox_id = 32
 UNION ALL SELECT 'sandbox', profile_hash FROM sandbox_profiles WHERE profile_id = 'profile3' UNION ALL SELECT 'secret', label FROM secret_refs WHERE secret_ref = 'secret9'""",
 "outbox_items", "sandbox_profiles", "secret_refs"))
def p10_side_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Point lookups in outbox items, sandbox profiles and secret references."""
    outbox, profiles, secrets = d.outbox_items(spark, sf), d.sandbox_profiles(spark, sf), d.secret_refs(spark, sf)
    item = ledger.lookup(outbox, outbox_id=32)
    found = {"outbox": item.select("status"), "kind": item.select("kind"), "sandbox": ledger.lookup(profiles, profile_id="profile3").select("profile_hash"), "secret": ledger.lookup(secrets, secret_ref="secret9").select("label")}
    return reduce(DataFrame.unionByName, [x.toDF("value").select(F.lit(name).alias("lookup"), "value") for name, x in found.items()])


@query(sql("""SELECT 'bindings' AS list, server_id || '/' || binding_id AS key FROM part_bindings UNION ALL SELECT 'bindings of srv3', binding_id FROM part_bindings WHERE server_id = 'srv3'
 UNION ALL SELECT 'secrets', secret_ref FROM secret_refs UNION ALL SELECT 'profiles', profile_id FROM sandbox_profiles UNION ALL SELECT 'drafts', CAST(outbox_id AS VARCHAR) FROM outbox_items WHERE status = 'Drafted'""",
 "part_bindings", "secret_refs", "sandbox_profiles", "outbox_items"))
def p11_side_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Whole lists in a total order: bindings, secret references, profiles, drafts."""
    b = d.part_bindings(spark, sf)
    lists = {
        "bindings": ledger.listed(b, "server_id", "binding_id").select(F.concat("server_id", F.lit("/"), "binding_id")), "bindings of srv3": ledger.listed(b, "binding_id", server_id="srv3").select("binding_id"),
        "secrets": ledger.listed(d.secret_refs(spark, sf), "secret_ref").select("secret_ref"), "profiles": ledger.listed(d.sandbox_profiles(spark, sf), "profile_id").select("profile_id"),
        "drafts": ledger.listed(d.outbox_items(spark, sf), "outbox_id", status="Drafted").select(F.col("outbox_id").cast("string")),
    }
    return reduce(DataFrame.unionByName, [x.toDF("key").select(F.lit(name).alias("list"), "key") for name, x in lists.items()])


@query(sql("""SELECT kind, CASE kind WHEN 'env_assignment' THEN 'secret' WHEN 'email' THEN 'email' ELSE 'url' END AS label, CASE kind WHEN 'env_assignment' THEN 25 ELSE 10 END AS risk, count(*) AS n FROM findings GROUP BY kind
 UNION ALL SELECT event_type, NULL, 5, count(*) FROM ledger_events GROUP BY event_type""", "findings", "ledger_events"))  # fmt: skip
def r11_risk_of_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """Label and risk of every kind that is found in documents, and of kinds that no rule knows."""
    kinds = d.findings(spark, sf).select("kind").unionByName(d.events(spark, sf).select(F.col("event_type").alias("kind")))
    return kinds.groupBy("kind").agg(F.count("*").alias("n")).select("kind", redaction.label_of(F.col("kind")).alias("label"), redaction.risk_of(F.col("kind")).alias("risk"), "n")


_DEEP = '{{"a":[{{"b":{{"password":{0},"c":[1,{{"Api-Key":{0}}}]}}}},{1}],"n":null}}'
_MASK = """'"[REDACTED len=' || strlen(event_type) || ' by_key=' || {0} || ']"'"""
_DEEP_SQL = " || ".join(["""'{"a":[{"b":{"c":[1,{"Api-Key":'""", _MASK.format("'Api-Key'"), """'}],"password":'""", _MASK.format("'password'"), """'}},' || user_id || '],"n":null}'"""])


@query(f"SELECT event_id, {_DEEP_SQL} AS clean FROM events")
def r7_redact_nested_json(spark: SparkSession, sf: str) -> DataFrame:
    """Secrets under sensitive keys at several depths, in objects and arrays."""
    quoted = F.concat(F.lit('"'), F.col("event_type"), F.lit('"'))
    parts = _DEEP.format("\x00", "\x01").replace("\x01", "\x00").split("\x00")
    values = [quoted, quoted, F.col("user_id").cast("string")]
    raw = F.concat(*[c for part, v in zip(parts, [*values, None], strict=True) for c in ([F.lit(part)] if v is None else [F.lit(part), v])])
    return d.load(spark, sf, "events").select("event_id", json_walk.redact_json(raw)["value"].alias("clean"))


_PLANTED = "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in _SECRETS.values()) + "]"
_STREAM = f"'see ' || coalesce(({_PLANTED})[CAST({{0}} AS BIGINT) + 1], 'nothing') || ' there'"
_LEAKS = ", ".join("CASE WHEN regexp_matches(a, '{0}') OR regexp_matches(b, '{0}') THEN '{1}' END".format(p.replace("'", "''"), n) for n, p in redaction.HARD_RULES)


@query(f"""SELECT event_id, array_to_string(list_filter([{_LEAKS}], lambda x: x IS NOT NULL), ',') AS leaks
 FROM (SELECT event_id, {_STREAM.format("event_id % 13")} AS a, {_STREAM.format("(event_id // 13) % 13")} AS b FROM events)""")
def r32_leaks_of_both_streams(spark: SparkSession, sf: str) -> DataFrame:
    """Each hard rule in the output and in the error stream of a tool, in every combination."""
    planted = F.array(*[F.lit(x) for x in _SECRETS.values()])
    stream = lambda k: F.concat(F.lit("see "), F.coalesce(F.get(planted, k.cast("int")), F.lit("nothing")), F.lit(" there"))
    e = d.load(spark, sf, "events")
    return e.select("event_id", F.array_join(redaction.leak_scan(stream(F.col("event_id") % 13), stream(F.expr("event_id div 13 % 13"))), ",").alias("leaks"))


@query("""SELECT CAST(item_id AS VARCHAR) AS id, 'bucket=' || (item_id % 3) AS bucket, sha256(text) AS text_sha256, 1 AS n_expected, 'email' AS label, strlen(text) AS "end" FROM benchmark""")
def s6_labelled_samples(spark: SparkSession, sf: str) -> DataFrame:
    """All benchmark items as labelled samples, a JSON file each in folders by bucket, read back."""
    path = scratch_path(spark, "samples")
    finding = F.struct(F.lit("email").alias("label"), F.lit(0).alias("start"), F.octet_length("text").alias("end"), F.lit("x").alias("extracted_text"), F.lit("low").alias("risk_tier"), F.lit("mask").alias("redact_action"))
    rows = d.load(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("id"), "text", F.lit("en").alias("lang"), F.array(finding).alias("expected_findings"), (F.col("item_id") % 3).alias("bucket"))
    rows.write.option("maxRecordsPerFile", 1).partitionBy("bucket").json(path)
    found = F.col("expected_findings")
    return schemas.read_samples(spark, path).select("id", "bucket", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), F.size(found).alias("n_expected"), found[0]["label"].alias("label"), found[0]["end"].alias("end"))
