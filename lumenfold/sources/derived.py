"""Ledger tables derived from the synthetic tables, by rules that SQL can repeat.

Each function here has its counterpart in DERIVED_SQL, for checking queries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing, redaction
from ..operators import ledger
from ..operators.store import LedgerStore
from .scratch import scratch_path

#: The pinned time of queries that need one, and that of the first scan.
NOW, SCAN_T0 = 1_700_050_000, 1_700_000_000


TEXTS = ("documents", "pages")
#: Session setting: deal tables of texts to all cores. A small file is one row group and so
#: one task; large tables have tasks enough of their own, and would only be shuffled.
DEAL = "lumenfold.sources.dealTexts"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name in TEXTS and spark.conf.get(DEAL, "false") == "true":
        return df.repartition(spark.sparkContext.defaultParallelism)
    return df


#: Tasks for each core, so that one that is slow or holds long texts doesn't keep the others waiting.
TASKS_A_CORE = 4


def dealt(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt to tasks by a key that is unique or nearly so, before work that costs far more than
    a shuffle: a file may be one row group, whatever its size, and would be read by one task."""
    return df.repartition(TASKS_A_CORE * df.sparkSession.sparkContext.defaultParallelism, key)


def _case(key: str, values: list[str]) -> Column:
    c = F.lit(values[-1])
    for i in range(len(values) - 2, -1, -1):
        c = F.when(F.expr(key) == i, values[i]).otherwise(c)
    return c


TOOL_TYPES = ["tool_call.opened", "tool_call.decided", "tool_call.executed", "tool_call.abandoned"]
VIEW_TYPES = ["approval.created", "approval.resolved", "decision.recorded"]
SIGNUP_TYPES = [ledger.LEAK, "tool_approval.drift_rejected"]


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger's events, not chained."""
    kind = (
        F.when(F.col("event_type") == "click", _case("event_id % 4", TOOL_TYPES)).when(F.col("event_type") == "view", _case("event_id % 3", VIEW_TYPES)).when(F.col("event_type") == "purchase", ledger.RAW_SECRET)
        .when(F.col("event_type") == "signup", _case("event_id % 2", SIGNUP_TYPES)).otherwise(ledger.ALIAS)
    )
    text = F.when(F.col("event_id") % 11 != 0, F.concat(F.col("event_type"), F.lit(" "), F.floor("value").cast("long").cast("string")))
    at = F.expr("(ts - timestamp_ntz'1970-01-01') div interval '1' second")
    return load(spark, sf_dir, "events").select("event_id", F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("session_id"), kind.alias("event_type"), F.col("props").alias("payload_json"), text.alias("redacted_text"), at.alias("created_at"))


#: Ledgers stored by this process, by application and tables.
_STORED: dict[tuple[str, str], LedgerStore] = {}


def stored(spark: SparkSession, sf_dir: str) -> LedgerStore:
    """The events as a committed ledger, which is made once and then read."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORED or not _STORED[key].version():
        _STORED[key] = LedgerStore(spark, scratch_path(spark, "ledger"))
        _STORED[key].adopt(events(spark, sf_dir))
    return _STORED[key]


def chained(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir).events()


def tampered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chained events with the payload of every 97th changed afterwards."""
    return chained(spark, sf_dir).withColumn("payload_json", F.when(F.col("event_id") % 97 == 0, '{"k":-1}').otherwise(F.col("payload_json")))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events").select("user_id", F.expr("(ts - timestamp_ntz'1970-01-01') div interval '1' second").alias("at"), "event_type")
    got = e.groupBy("user_id").agg(F.min("at").alias("started_at"), F.max("at").alias("last"), F.count_if(F.col("event_type") == "purchase").alias("n"))
    source = _case("user_id % 4", ["mcp_client", "browser", "desktop", "cli"])
    return got.select(F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("session_id"), source.alias("source"), "started_at", F.when(F.col("user_id") % 3 != 0, F.col("last")).alias("ended_at"), F.least(F.lit(100), F.col("n") * 8).alias("risk_score"))


def scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return load(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("scan_id"), F.concat(F.lit("s"), (F.col("doc_id") % 50).cast("string")).alias("session_id"), _case("doc_id % 4", list(ledger.SCAN_SOURCES)).alias("source"),
        (SCAN_T0 + F.col("doc_id") * 60).alias("ts"), hashing.bit_bucket(F.octet_length(text)).alias("len_bucket"), hashing.fingerprint(text).alias("fingerprint"),
    )


FINDING_RULES = [("env_assignment", redaction.ENV), ("email", redaction.EMAIL), ("internal_ipv4", redaction.IPV4), ("generic_url", redaction.URL)]


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each match of a rule in a document: scan_id, kind, label, start, end."""
    docs = load(spark, sf_dir, "documents").filter("text is not null")
    spans = docs.select(F.col("doc_id").alias("scan_id"), F.explode(redaction.all_spans(F.col("text"), FINDING_RULES)).alias("s"))
    return spans.select("scan_id", "s.kind", redaction.label_of(F.col("s.kind")).alias("label"), "s.start", "s.end")


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool calls, one for each page, of six kinds by page_id."""
    kind = F.col("page_id") % 6
    pid = F.col("page_id").cast("string")
    j = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    args = (
        F.when(kind == 0, j('{"url":"', F.col("url"), '"}')).when(kind == 1, j('{"path":"src/x/../a', pid, '.txt"}')).when(kind == 2, F.when(F.col("page_id") % 4 == 0, F.lit('{"path":"/etc/passwd"}')).otherwise(j('{"path":"/work/p', pid, '.md"}')))
        .when(kind == 3, F.when(F.col("page_id") % 4 == 1, F.lit('{"sql":"DELETE FROM t"}')).otherwise(F.lit('{"sql":"SELECT 1"}'))).when(kind == 4, F.when(F.col("page_id") % 4 == 0, F.lit('{"command":"rm -rf /tmp/x"}')).otherwise(F.lit('{"command":"ls -la"}')))
        .otherwise(F.lit('{"to":["a@example.org","b@example.org"],"body":"secret://db/password"}'))
    )
    return load(spark, sf_dir, "pages").select(
        F.col("page_id").alias("invocation_id"), F.concat(F.lit("s"), (F.col("page_id") % 50).cast("string")).alias("session_id"), _case("page_id % 6", ["web", "filesystem", "filesystem", "postgres", "shell", "mail"]).alias("server_id"),
        _case("page_id % 6", ["fetch", "read_file", "write_file", "query", "run", "send_mail"]).alias("tool_name"), args.alias("args"), F.sha2(_case("page_id % 7", ["a", "b", "c", "a", "a", "a", "a"]).cast("binary"), 256).alias("descriptor_hash"),
    )


def servers(spark: SparkSession) -> DataFrame:
    rows = [("web", "Trusted", None), ("filesystem", "Limited", "h2"), ("postgres", "Trusted", None), ("shell", "Untrusted", None), ("mail", "Trusted", "h9")]
    return spark.createDataFrame(rows, "server_id string, trust_level string, pending_command_hash string")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as events, one for each turn."""
    at = F.col("conv_id") * 1000 + F.col("turn")
    return load(spark, sf_dir, "conversations").select(at.alias("event_id"), F.concat(F.lit("s"), (F.col("conv_id") % 50).cast("string")).alias("session_id"), F.concat(F.lit("turn."), "role").alias("event_type"), F.col("text").alias("redacted_text"), (SCAN_T0 + at).alias("created_at"))


def server_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A server for each supplier."""
    k = F.col("s_suppkey")
    return load(spark, sf_dir, "supplier").select(F.concat(F.lit("srv"), k.cast("string")).alias("server_id"), _case("s_suppkey % 3", ["Untrusted", "Limited", "Trusted"]).alias("trust_level"), F.when(k % 5 == 0, F.concat(F.lit("h"), k.cast("string"))).alias("pending_command_hash"), F.col("s_name").alias("command_json"))


def tool_descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tool for each part, on one of ten servers."""
    k = F.col("p_partkey")
    return load(spark, sf_dir, "part").select(
        F.concat(F.lit("srv"), (k % 10).cast("string")).alias("server_id"), F.concat(F.lit("tool"), k.cast("string")).alias("tool_name"), F.sha2(F.col("p_name").cast("binary"), 256).alias("descriptor_hash"),
        F.when(k % 4 != 0, k).alias("approved_at"), F.when(k % 6 == 0, F.lit("new")).alias("pending_hash"),
    )


def part_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A secret's binding for each part; `rare` are those of single tools, and few others."""
    k = F.col("p_partkey")
    return load(spark, sf_dir, "part").select(
        F.concat(F.lit("b"), k.cast("string")).alias("binding_id"), F.concat(F.lit("srv"), (k % 10).cast("string")).alias("server_id"), F.when(k % 4 == 0, "*").otherwise(F.concat(F.lit("tool"), k.cast("string"))).alias("tool_name"),
        F.concat(F.lit("secret"), (k % 50).cast("string")).alias("secret_ref"), _case("p_partkey % 3", ["ChildEnv", "Header", "File"]).alias("injection_method"), F.when(k % 3 == 0, F.concat(F.lit("KEY_"), (k % 7).cast("string"))).alias("env_key"),
        ((k % 4 != 0) | (k < 100)).alias("rare"),
    )


def secret_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A secret for each customer."""
    name = F.col("c_name")
    return load(spark, sf_dir, "customer").select(F.concat(F.lit("secret"), F.col("c_custkey").cast("string")).alias("secret_ref"), name.alias("label"), hashing.fingerprint(name).alias("fingerprint"))


def sandbox_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sandbox profile for each supplier."""
    body = F.concat(F.lit('{"name":"'), F.col("s_name"), F.lit('"}'))
    return load(spark, sf_dir, "supplier").select(F.concat(F.lit("profile"), F.col("s_suppkey").cast("string")).alias("profile_id"), body.alias("profile_json"), F.sha2(body.cast("binary"), 256).alias("profile_hash"))


def outbox_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An outbox item for each order."""
    status = F.when(F.col("o_orderstatus") == "O", "Drafted").when(F.col("o_orderstatus") == "F", "Executed").otherwise("PendingApproval")
    return load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("outbox_id"), F.concat(F.lit("s"), (F.col("o_custkey") % 50).cast("string")).alias("session_id"), _case("o_orderkey % 3", ["mail", "post", "file"]).alias("kind"), status.alias("status"))


def oauth_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A token for each customer."""
    return load(spark, sf_dir, "customer").select(F.concat(F.lit("t"), F.col("c_custkey").cast("string")).alias("token_ref"), F.col("c_mktsegment").alias("issuer"), F.col("c_name").alias("resource"))


def pins(spark: SparkSession) -> DataFrame:
    import hashlib

    a = hashlib.sha256(b"a").hexdigest()
    rows = [("web", "fetch", a, 10, None), ("filesystem", "read_file", a, 11, None), ("filesystem", "write_file", a, None, None), ("postgres", "query", a, 12, "h3"), ("shell", "run", a, 13, None), ("mail", "send_mail", a, 14, None)]
    return spark.createDataFrame(rows, "server_id string, tool_name string, descriptor_hash string, approved_at long, pending_hash string")


def bindings(spark: SparkSession) -> DataFrame:
    rows = [("b1", "web", "*", "ChildEnv", "API_KEY"), ("b2", "web", "fetch", "ChildEnv", "TOKEN"), ("b3", "mail", "send_mail", "Header", None), ("b4", "postgres", "query", "ChildEnv", "PG_PASS"), ("b5", "postgres", "*", "ChildEnv", "PG_PASS")]
    return spark.createDataFrame(rows, "binding_id string, server_id string, tool_name string, injection_method string, env_key string")


def approvals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One approval for each order: status by its state, five minutes to live."""
    at = F.expr("(o_orderdate - timestamp_ntz'1970-01-01') div interval '1' second")
    status = F.when(F.col("o_orderstatus") == "F", "Approved").when(F.col("o_orderstatus") == "O", "Pending").otherwise("Denied")
    return load(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("approval_id"), F.concat(F.lit("s"), (F.col("o_custkey") % 50).cast("string")).alias("session_id"), _case("o_custkey % 3", ["web", "filesystem", "mail"]).alias("server_id"),
        _case("o_custkey % 3", ["fetch", "read_file", "send_mail"]).alias("tool_name"), (F.col("o_custkey") % 20).cast("string").alias("args_hash"), status.alias("status"),
        F.when(F.col("o_orderkey") % 2 == 0, "ThisSession").otherwise("Once").alias("scope"), at.alias("created_at"), (at + 300).alias("expires_at"), F.when(status != "Pending", at + F.col("o_orderkey") % 300).alias("resolved_at"),
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptor observations and decisions, one for each event, for (user, event type)."""
    op = F.when(F.col("event_id") % 13 == 0, "approve").when(F.col("event_id") % 29 == 0, "reject").when(F.col("event_id") % 17 == 0, "approve_to").otherwise("observe")
    return load(spark, sf_dir, "events").select(F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("server_id"), F.col("event_type").alias("tool_name"), F.col("event_id").alias("seq"), op.alias("op"), (F.col("event_id") % 3).cast("string").alias("hash"), F.expr("(ts - timestamp_ntz'1970-01-01') div interval '1' second").alias("at"))


_TYPE_SQL = f"""CASE event_type WHEN 'click' THEN CASE event_id % 4 WHEN 0 THEN '{TOOL_TYPES[0]}' WHEN 1 THEN '{TOOL_TYPES[1]}' WHEN 2 THEN '{TOOL_TYPES[2]}' ELSE '{TOOL_TYPES[3]}' END
 WHEN 'view' THEN CASE event_id % 3 WHEN 0 THEN '{VIEW_TYPES[0]}' WHEN 1 THEN '{VIEW_TYPES[1]}' ELSE '{VIEW_TYPES[2]}' END
 WHEN 'purchase' THEN '{ledger.RAW_SECRET}' WHEN 'signup' THEN CASE event_id % 2 WHEN 0 THEN '{SIGNUP_TYPES[0]}' ELSE '{SIGNUP_TYPES[1]}' END ELSE '{ledger.ALIAS}' END"""
_sql_text = lambda p: p.replace("'", "''")
DERIVED_SQL = {
    "ledger_events": f"""SELECT event_id, 's' || user_id AS session_id, {_TYPE_SQL} AS event_type, props AS payload_json,
 CASE WHEN event_id % 11 <> 0 THEN event_type || ' ' || CAST(floor(value) AS BIGINT) END AS redacted_text, CAST(floor(epoch(ts)) AS BIGINT) AS created_at FROM events""",
    "sessions": """SELECT 's' || user_id AS session_id, CASE user_id % 4 WHEN 0 THEN 'mcp_client' WHEN 1 THEN 'browser' WHEN 2 THEN 'desktop' ELSE 'cli' END AS source,
 min(CAST(floor(epoch(ts)) AS BIGINT)) AS started_at, CASE WHEN user_id % 3 <> 0 THEN max(CAST(floor(epoch(ts)) AS BIGINT)) END AS ended_at, least(100, count(*) FILTER (event_type = 'purchase') * 8) AS risk_score FROM events GROUP BY user_id""",
    "scans": f"""SELECT doc_id AS scan_id, 's' || (doc_id % 50) AS session_id, CASE doc_id % 4 WHEN 0 THEN 'paste' WHEN 1 THEN 'tool_arg' WHEN 2 THEN 'tool_output' ELSE 'export' END AS source, {SCAN_T0} + doc_id * 60 AS ts,
 CASE WHEN strlen(coalesce(text, '')) = 0 THEN 0 ELSE length(ltrim(bin(strlen(coalesce(text, ''))), '0')) END AS len_bucket, substr(sha256(coalesce(text, '')), 1, 32) AS fingerprint FROM documents""",
    "findings": " UNION ALL ".join(f"""SELECT doc_id AS scan_id, '{name}' AS kind, '{redaction.LABEL_OF[name]}' AS label, unnest(regexp_extract_all(text, '{_sql_text(p)}', 0)) AS m FROM documents""" for name, p in FINDING_RULES),
    "calls": """SELECT page_id AS invocation_id, 's' || (page_id % 50) AS session_id, page_id, url, page_id % 6 AS k FROM pages""",
    "approvals": """SELECT o_orderkey AS approval_id, 's' || (o_custkey % 50) AS session_id, CASE o_custkey % 3 WHEN 0 THEN 'web' WHEN 1 THEN 'filesystem' ELSE 'mail' END AS server_id,
 CASE o_custkey % 3 WHEN 0 THEN 'fetch' WHEN 1 THEN 'read_file' ELSE 'send_mail' END AS tool_name, CAST(o_custkey % 20 AS VARCHAR) AS args_hash, CASE o_orderstatus WHEN 'F' THEN 'Approved' WHEN 'O' THEN 'Pending' ELSE 'Denied' END AS status,
 CASE WHEN o_orderkey % 2 = 0 THEN 'ThisSession' ELSE 'Once' END AS scope, CAST(floor(epoch(o_orderdate)) AS BIGINT) AS created_at, CAST(floor(epoch(o_orderdate)) AS BIGINT) + 300 AS expires_at,
 CASE WHEN o_orderstatus <> 'O' THEN CAST(floor(epoch(o_orderdate)) AS BIGINT) + o_orderkey % 300 END AS resolved_at FROM orders""",
    "turns": f"SELECT conv_id * 1000 + turn AS event_id, 's' || (conv_id % 50) AS session_id, 'turn.' || role AS event_type, text AS redacted_text, {SCAN_T0} + conv_id * 1000 + turn AS created_at FROM conversations",
    "server_profiles": "SELECT 'srv' || s_suppkey AS server_id, CASE s_suppkey % 3 WHEN 0 THEN 'Untrusted' WHEN 1 THEN 'Limited' ELSE 'Trusted' END AS trust_level, CASE WHEN s_suppkey % 5 = 0 THEN 'h' || s_suppkey END AS pending_command_hash, s_name AS command_json FROM supplier",
    "tool_descriptors": "SELECT 'srv' || (p_partkey % 10) AS server_id, 'tool' || p_partkey AS tool_name, sha256(p_name) AS descriptor_hash, CASE WHEN p_partkey % 4 <> 0 THEN p_partkey END AS approved_at, CASE WHEN p_partkey % 6 = 0 THEN 'new' END AS pending_hash FROM part",
    "part_bindings": """SELECT 'b' || p_partkey AS binding_id, 'srv' || (p_partkey % 10) AS server_id, CASE WHEN p_partkey % 4 = 0 THEN '*' ELSE 'tool' || p_partkey END AS tool_name, 'secret' || (p_partkey % 50) AS secret_ref,
 CASE p_partkey % 3 WHEN 0 THEN 'ChildEnv' WHEN 1 THEN 'Header' ELSE 'File' END AS injection_method, CASE WHEN p_partkey % 3 = 0 THEN 'KEY_' || (p_partkey % 7) END AS env_key, p_partkey % 4 <> 0 OR p_partkey < 100 AS rare FROM part""",
    "secret_refs": "SELECT 'secret' || c_custkey AS secret_ref, c_name AS label, substr(sha256(c_name), 1, 32) AS fingerprint FROM customer",
    "sandbox_profiles": """SELECT 'profile' || s_suppkey AS profile_id, '{"name":"' || s_name || '"}' AS profile_json, sha256('{"name":"' || s_name || '"}') AS profile_hash FROM supplier""",
    "outbox_items": """SELECT o_orderkey AS outbox_id, 's' || (o_custkey % 50) AS session_id, CASE o_orderkey % 3 WHEN 0 THEN 'mail' WHEN 1 THEN 'post' ELSE 'file' END AS kind,
 CASE o_orderstatus WHEN 'O' THEN 'Drafted' WHEN 'F' THEN 'Executed' ELSE 'PendingApproval' END AS status FROM orders""",
    "oauth_metadata": "SELECT 't' || c_custkey AS token_ref, c_mktsegment AS issuer, c_name AS resource FROM customer",
    "servers": "SELECT * FROM (VALUES ('web','Trusted',NULL),('filesystem','Limited','h2'),('postgres','Trusted',NULL),('shell','Untrusted',NULL),('mail','Trusted','h9')) v(server_id, trust_level, pending_command_hash)",
    "bindings": "SELECT * FROM (VALUES ('b1','web','*','ChildEnv','API_KEY'),('b2','web','fetch','ChildEnv','TOKEN'),('b3','mail','send_mail','Header',NULL),('b4','postgres','query','ChildEnv','PG_PASS'),('b5','postgres','*','ChildEnv','PG_PASS')) v(binding_id, server_id, tool_name, injection_method, env_key)",
}


def sql(body: str, *names: str) -> str:
    """A query over derived tables for DuckDB: `body` after the CTEs that it names."""
    return "WITH " + ", ".join(f"{n} AS ({DERIVED_SQL[n]})" for n in names) + " " + body
