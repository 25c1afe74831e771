"""Effects of a tool call, its risk score and related decisions, as Column expressions.

A call has the columns server_id, tool_name, args (JSON). Paths are normalised lexically.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Argument names, word lists, patterns and weights.
PATH_KEYS = ["path", "paths", "file", "files", "filename", "filepath", "src", "source", "dst", "dest", "destination", "target", "dir", "directory", "folder", "input", "output"]
WRITE_WORDS = ["write", "create", "edit", "patch", "delete", "unlink", "rm", "move", "rename", "append", "chmod", "chown", "mkdir", "remove", "truncate", "overwrite", "save", "upload"]
URL_KEYS = ["url", "endpoint", "uri", "href", "link", "webhook", "webhook_url", "callback_url"]
SQL_KEYS = ["sql", "query", "statement"]
RECIPIENT_KEYS = ["to", "cc", "bcc", "recipients"]
SQL_DESTRUCTIVE = r"(?i)\b(DELETE|DROP|TRUNCATE|ALTER|UPDATE|REPLACE)\b"
SQL_READ = r"(?i)^\s*(SELECT|SHOW|DESCRIBE|EXPLAIN|WITH)\b"
SECRET_REF = r"secret://[A-Za-z0-9._\-/]+"
DESTRUCTIVE_BINARIES = ["rm", "rmdir", "shred", "mkfs", "fdisk", "format", "del", "dd", "srm", "erase"]
SHELLS = ["sh", "bash", "zsh", "ksh", "dash", "fish", "cmd", "powershell", "pwsh"]
EVAL_FLAGS = ["-c", "-lc", "-Command", "/c", "/C", "-Cmd", "--command"]
PROTECTED = ["/", "/etc", "/usr", "/var", "/bin", "/sbin", "/boot", "/sys", "/proc", "~", "~/.ssh", "~/.config", "~/.aws", "~/.docker", "C:\\", "C:\\Windows", "%SystemRoot%", "%USERPROFILE%\\.ssh"]
META = ["&&", "||", "|", "&", ";", ">", ">>", "<", "<<", "$(", "`", "\\\n"]
#: Well-known servers: (hints in the server's name, effects, tools).
CATALOG = [
    (["filesystem", "file", "fs"], ["FsRead"], ["read_file", "read_text_file", "read_media_file", "read_multiple_files", "list_directory", "list_directory_with_sizes", "directory_tree", "search_files", "get_file_info"]),
    (["filesystem", "file", "fs"], ["FsWrite"], ["write_file", "edit_file", "create_directory", "move_file"]),
    (["fetch", "http", "web"], ["NetOutbound"], ["fetch"]),
    (["git"], ["FsRead"], ["git_status", "git_log", "git_diff", "git_show"]),
    (["git"], ["FsWrite"], ["git_add", "git_commit"]),
    (["github"], ["NetOutbound", "SecretUse"], ["search_repositories", "get_file_contents", "get_issue", "list_issues"]),
    (["github"], ["NetOutbound", "SecretUse", "CommSend"], ["create_issue", "create_pull_request", "add_issue_comment", "create_or_update_file", "push_files"]),
    (["brave"], ["NetOutbound", "SecretUse"], ["brave_web_search", "brave_local_search"]),
    (["slack"], ["NetOutbound", "SecretUse", "CommSend"], ["slack_post_message", "slack_reply_to_thread"]),
    (["postgres", "postgresql", "pg"], ["DbRead"], ["query"]),
]
WEIGHTS = {"first_seen": 15, "drifted": 25, "write": 20, "outside": 30, "net": 15, "host": 20, "secret": 25, "exec": 30, "destructive": 35, "send": 25}
EFFECT_KINDS = ["FsRead", "FsWrite", "DbRead", "DbWrite", "NetOutbound", "ExecWasm", "ExecNative", "SecretUse", "BrowserSubmit", "CommSend", "CredentialExchange"]
TTL_S, ESCALATION = 300, 24


def _empty() -> Column:
    return F.expr("cast(array() as array<string>)")


def _strings(words: list[str]) -> Column:
    """Fixed strings as an array, by one expression whatever their number."""
    quote = lambda w: "'" + w.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"
    return F.expr(f"array({', '.join(map(quote, words))})")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value made once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _text(v: Column) -> Column:
    """A variant as a string; null where it isn't one."""
    return F.when(F.schema_of_variant(v) == "STRING", v.cast("string"))


def _texts(v: Column) -> Column:
    """The string of a variant, or the strings of an array, as an array."""
    listed = F.array_compact(F.transform(F.try_variant_get(v, "$", "array<variant>"), _text))
    return F.coalesce(F.when(F.schema_of_variant(v) == "STRING", F.array(v.cast("string"))), listed, _empty())


def _listed(fields: Column, keys: list[str]) -> Column:
    """The strings of some arguments, single or in arrays; fields: a map of variants by name."""
    return F.flatten(F.transform(_strings(keys), lambda k: _texts(F.try_element_at(fields, k))))


def _single(fields: Column, keys: list[str]) -> Column:
    """Those of some arguments that are strings."""
    return F.array_compact(F.transform(_strings(keys), lambda k: _text(F.try_element_at(fields, k))))


#: A run of blanks, or a part of a word: quoted, escaped or plain.
SHELL_PIECE = r"""(?s)[ \t\r\n]+|'[^']*'|"[^"\\]*+(?:\\.[^"\\]*+)*+"|\\.|[^ \t\r\n'"\\]+"""


def shell_split(line: Column) -> Column:
    """The words of a command line by POSIX quoting; null where a quote or an escape is open."""
    blank = lambda x: x.rlike(r"^[ \t\r\n]")
    inner = lambda x: F.substring(x, F.lit(2), F.length(x) - 2)
    plain = lambda x: F.when(x.startswith("'"), inner(x)).when(x.startswith('"'), F.regexp_replace(inner(x), r'\\(["\\])', "$1")).when(x.startswith("\\"), F.substring(x, 2, 1)).otherwise(x)
    # words are put together from the end of the list of words so far
    step = lambda acc, x: F.when(blank(x), F.struct(acc["done"].alias("done"), F.lit(None).cast("string").alias("word"))).otherwise(
        F.struct(F.when(acc["word"].isNull(), F.concat(acc["done"], F.array(plain(x)))).otherwise(F.concat(F.slice(acc["done"], 1, F.size(acc["done"]) - 1), F.array(F.concat(acc["word"], plain(x))))).alias("done"), F.concat(F.coalesce(acc["word"], F.lit("")), plain(x)).alias("word"))
    )
    start = F.struct(_empty().alias("done"), F.lit(None).cast("string").alias("word"))
    words = lambda ps: F.aggregate(ps, start, step, lambda acc: acc["done"])
    return _let(F.regexp_extract_all(line, F.lit(SHELL_PIECE), F.lit(0)), lambda ps: F.when(F.array_join(ps, "") == line, words(ps)))


def _has(words: list[str], text: Column) -> Column:
    return F.exists(_strings(words), text.contains)


def normal_path(path: Column, root: str | None) -> Column:
    """Absolute below root where it is relative, without `.`, `..` and backslashes."""
    p = F.regexp_replace(path, r"\\", "/")
    absolute = p.startswith("/") | p.rlike("^[A-Za-z]:/")
    full = F.when(absolute, p).otherwise(F.concat(F.lit((root or "").rstrip("/") + "/"), p)) if root else p
    rooted = full.startswith("/")
    step = lambda acc, x: F.when((x == "") | (x == "."), acc).when(
        (x == "..") & (F.size(acc) > 0) & (F.element_at(F.concat(F.array(F.lit("..")), acc), -1) != ".."), F.slice(acc, 1, F.size(acc) - 1)
    ).when((x == "..") & rooted, acc).otherwise(F.concat(acc, F.array(x)))
    parts = F.aggregate(F.split(full, "/"), _empty(), step)
    return F.when(rooted, F.concat(F.lit("/"), F.array_join(parts, "/"))).when(F.size(parts) == 0, ".").otherwise(F.array_join(parts, "/"))


def host_of(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def _shell(argv: Column) -> Column:
    """Whether a command is destructive."""
    full = F.array_join(argv, " ")
    base = F.lower(F.regexp_extract(F.element_at(F.concat(argv, F.array(F.lit(""))), 1), r"([^/\\]*)$", 1))
    bare = F.regexp_replace(base, r"\.exe$", "")
    rest = F.slice(argv, 2, F.greatest(F.size(argv) - 1, F.lit(0)))
    script = F.array_contains(_strings(SHELLS), bare) & F.exists(rest, lambda a: F.array_contains(_strings(EVAL_FLAGS), a) | a.contains(" ") | a.contains("\n"))
    below = lambda a, p: (a == p) | a.startswith(F.concat(p, F.lit("/"))) | a.startswith(F.concat(p, F.lit("\\")))
    protected = F.exists(F.transform(argv, lambda a: F.btrim(a, F.lit("'\""))), lambda a: F.exists(_strings(PROTECTED), lambda p: below(a, p)))
    return _has(META, full) | script | F.array_contains(_strings(DESTRUCTIVE_BINARIES), bare) | protected


def _arguments(fields: Column) -> Column:
    """What the extractors read of the arguments, each list made once."""
    first = lambda *keys: F.get(_single(fields, list(keys)), F.lit(0))
    more_urls = F.filter(_listed(fields, ["urls"]), lambda u: F.try_element_at(fields, F.lit("urls")).isNotNull() & (F.size(_single(fields, ["urls"])) == 0))
    return F.struct(
        _listed(fields, PATH_KEYS).alias("paths"), F.concat(_single(fields, URL_KEYS), more_urls).alias("urls"), _single(fields, SQL_KEYS).alias("statements"), _listed(fields, ["argv"]).alias("argv"), first("command", "cmd").alias("line"),
        _listed(fields, RECIPIENT_KEYS).alias("people"), first("action").alias("action"), first("origin").alias("origin"),
    )


def _derived(a: Column, args: Column, tool: Column, root: str | None) -> Column:
    """Normalised forms of the lists of _arguments()."""
    bad_sql = lambda s: F.regexp_like(s, F.lit("(?U)" + SQL_DESTRUCTIVE))
    sql = F.transform(a["statements"], lambda s: F.when(F.regexp_like(s, F.lit("(?U)" + SQL_READ)) & ~bad_sql(s), "DbRead").otherwise("DbWrite"))
    submits = F.coalesce(tool.contains("browser") & a["action"].isin("submit", "fill_form", "post"), F.lit(False))
    return F.struct(
        F.transform(a["paths"], lambda p: normal_path(p, root)).alias("paths"), _has(WRITE_WORDS, tool).alias("writes"), F.array_compact(F.transform(a["urls"], host_of)).alias("hosts"), sql.alias("sql"), F.exists(a["statements"], bad_sql).alias("bad_sql"),
        F.when(F.size(a["argv"]) > 0, a["argv"]).otherwise(shell_split(a["line"])).alias("argv"), ((F.size(a["argv"]) > 0) | a["line"].isNotNull()).alias("runs"), F.regexp_extract_all(args, F.lit(SECRET_REF), F.lit(0)).alias("refs"),
        a["people"].alias("people"), submits.alias("submits"), F.when(submits, host_of(a["origin"])).alias("origin"),
    )


def _vector(x: Column, known: Column) -> Column:
    """The effect vector from _derived() and the effects that the catalogue knows."""
    if_ = lambda cond, kind: F.when(cond, F.array(F.lit(kind))).otherwise(_empty())
    some = lambda name: F.coalesce(F.size(x[name]), F.lit(0)) > 0
    sorted_ = lambda a: F.array_sort(F.array_distinct(F.coalesce(a, _empty())))
    kinds = [known, if_(some("paths") & x["writes"], "FsWrite"), if_(some("paths") & ~x["writes"], "FsRead"), if_(some("hosts"), "NetOutbound"), x["sql"], if_(x["runs"], "ExecNative"), if_(some("people"), "CommSend"), if_(some("refs"), "SecretUse"), if_(x["submits"], "BrowserSubmit")]
    unsplit = x["runs"] & ~some("argv")
    destructive = x["bad_sql"] | unsplit | (x["runs"] & _shell(F.coalesce(x["argv"], _empty())))
    return F.struct(
        F.array_distinct(F.concat(*kinds)).alias("effects"), F.when(x["writes"], _empty()).otherwise(sorted_(x["paths"])).alias("paths_read"), F.when(x["writes"], sorted_(x["paths"])).otherwise(_empty()).alias("paths_write"),
        sorted_(F.concat(x["hosts"], F.array_compact(F.array(x["origin"])))).alias("network_hosts"), sorted_(x["refs"]).alias("secret_refs"), sorted_(x["people"]).alias("recipients"), F.coalesce(destructive, F.lit(False)).alias("destructive"),
    )


def effects(server_id: Column, tool_name: Column, args: Column, root: str | None = None) -> Column:
    """The effect vector: effects in the order found, sorted distinct lists, destructive.

    The arguments are parsed once, and each list is made once and then referred to.
    """
    tool, server = F.lower(tool_name), F.lower(server_id)
    fits = lambda c: F.array_contains(c["tools"], tool_name) & F.exists(c["hints"], server.contains)
    known = F.flatten(F.transform(F.filter(F.array(*[F.struct(_strings(h).alias("hints"), _strings(k).alias("kinds"), _strings(t).alias("tools")) for h, k, t in CATALOG]), fits), lambda c: c["kinds"]))
    fields = F.try_variant_get(F.try_parse_json(args), "$", "map<string,variant>")
    return _let(fields, lambda m: _let(_arguments(m), lambda a: _let(_derived(a, args, tool, root), lambda x: _vector(x, known))))


def under_root(path: Column, roots: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [(path == r) | path.startswith(r.rstrip("/") + "/") for r in roots]) if roots else F.lit(False)


def host_matches(host: Column, pattern: str) -> Column:
    """A pattern with a leading dot takes the name and all below it; others the name only."""
    return host.endswith(pattern) | (host == pattern[1:]) if pattern.startswith(".") else F.lower(host) == pattern.lower()


def score(e: Column, descriptor: Column, allowed_hosts: list[str], roots: list[str]) -> Column:
    """(risk 0..100, reasons by falling weight). Hosts must be in the list exactly."""
    has = lambda k: F.array_contains(e["effects"], k)
    outside = F.filter(e["paths_write"], lambda p: ~under_root(p, roots)) if roots else _empty()
    unknown = F.array_except(e["network_hosts"], F.array(*[F.lit(h) for h in allowed_hosts]).cast("array<string>"))
    quoted = lambda a: F.concat(F.lit("["), F.array_join(F.transform(a, lambda x: F.concat(F.lit('"'), x, F.lit('"'))), ", "), F.lit("]"))
    n = lambda a: F.size(a).cast("string")
    w, first = WEIGHTS, lambda a: F.get(a, F.lit(0))
    rows = [
        (descriptor == "FirstSeen", w["first_seen"], F.lit("first-seen MCP server")), (descriptor == "Drifted", w["drifted"], F.lit("descriptor hash drifted since last approval")),
        (has("FsWrite"), w["write"], F.concat(F.lit("writes local files: "), n(e["paths_write"]))), (has("FsWrite") & (F.size(outside) > 0), w["outside"], F.concat(F.lit("writes OUTSIDE project: "), first(outside))),
        (has("NetOutbound"), w["net"], F.concat(F.lit("outbound network: "), quoted(e["network_hosts"]))), (has("NetOutbound") & (F.size(unknown) > 0), w["host"], F.concat(F.lit("unknown host: "), first(unknown))),
        (has("SecretUse"), w["secret"], F.concat(F.lit("uses credential lease: "), quoted(e["secret_refs"]))), (has("ExecNative"), w["exec"], F.lit("runs native subprocess")),
        (e["destructive"], w["destructive"], F.lit("destructive operation detected")), (has("CommSend") | has("BrowserSubmit"), w["send"], F.concat(F.lit("sends to recipients / submits form: "), n(e["recipients"]))),
    ]
    found = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(-x).alias("w"), F.lit(i).alias("i"), r.alias("r"))) for i, (c, x, r) in enumerate(rows)]))
    total = F.aggregate(found, F.lit(0), lambda acc, x: acc - x["w"])
    return F.struct(F.least(total, F.lit(100)).alias("risk"), F.transform(F.array_sort(found), lambda x: x["r"]).alias("reasons"))


def final_risk(base: Column, pii: Column) -> Column:
    return F.least(F.lit(100), base + pii)


def summary(risk: Column, e: Column) -> Column:
    """One line for people."""
    join = lambda label, a: F.when(F.size(a) > 0, F.concat(F.lit(f"{label}: "), F.array_join(a, ", ")))
    count = lambda label, a: F.when(F.size(a) > 0, F.concat(F.lit(f"{label}: "), F.size(a).cast("string")))
    return F.concat_ws(" | ", F.concat(F.lit("risk "), risk.cast("string"), F.lit("/100")), join("writes", e["paths_write"]), count("reads", e["paths_read"]), join("hosts", e["network_hosts"]), join("secrets", e["secret_refs"]), count("recipients", e["recipients"]))


def effective_profile(base: Column, session_risk: Column) -> Column:
    """A session at or over the threshold counts one posture higher."""
    up = F.when(base == "low", "medium").otherwise("high")
    return F.when(session_risk >= ESCALATION, up).otherwise(base)


def posture(profile: Column, risk_class: Column) -> Column:
    return F.when(risk_class.isin("raw_secret", "ledger_tamper"), "deny").when(profile == "low", "allow").when(profile == "medium", "ask").otherwise("deny")


def ui_risk(e: Column, n_findings: Column) -> Column:
    """(score, band) as the approval page shows it."""
    write = F.arrays_overlap(e["effects"], F.array(*[F.lit(k) for k in ("FsWrite", "DbWrite", "ExecWasm", "ExecNative")]))
    total = F.least(F.lit(100), sum([F.when(c, x).otherwise(0) for c, x in ((e["destructive"], 30), (F.size(e["secret_refs"]) > 0, 25), ((F.size(e["network_hosts"]) > 0) | (F.size(e["recipients"]) > 0), 20), (write, 15), (n_findings > 0, 10))], F.lit(0)))
    return F.struct(total.alias("score"), F.when(total >= 70, "high").when(total >= 40, "medium").otherwise("low").alias("band"))


def public_name(server: Column, tool: Column) -> Column:
    return F.concat(server, F.lit("__"), tool)


def parse_public_name(name: Column) -> Column:
    """(server, tool) split at the first double underscore; null where there is none or a side is empty."""
    at = F.instr(name, "__")
    return F.when((at > 1) & (at + 1 < F.length(name)), F.struct(F.substring(name, F.lit(1), at - 1).alias("server"), F.substring(name, at + 2, F.length(name)).alias("tool")))


def hook_gate(tool_name: Column, tool_input: Column, raw_secret: Column, profile: Column, session_risk: Column, prefixes: tuple[str, ...] = ("secret://", "lumenfold://redact/")) -> Column:
    """allow, ask or deny before a tool runs: raw secrets are denied, placeholders for
    native tools go by posture."""
    placeholder = _has(list(prefixes), tool_input) & ~tool_name.startswith("mcp__")
    return F.when(raw_secret.isNotNull(), "deny").when(placeholder, posture(effective_profile(profile, session_risk), F.lit("placeholder_native"))).otherwise("allow")


def lease_error(now: Column, expires_at: Column, revoked_at: Column, session: Column, lease_session: Column, server: Column, lease_server: Column, tool: Column, lease_tool: Column) -> Column:
    """Why a lease can't be used, or null. The checks are made in this order."""
    return (
        F.when(lease_session.isNull(), "not_found").when(revoked_at.isNotNull(), "revoked").when(expires_at <= now, "expired").when(session != lease_session, "session_mismatch")
        .when(server != lease_server, "server_mismatch").when(tool != lease_tool, "tool_mismatch")
    )


def monitor_overlay(monitor: Column, action: Column, policy_ids: Column, descriptor: Column) -> Column:
    """In monitor mode the default denial becomes an observed allowance, and approvals are
    observed too, but for drifted descriptors; explicit denials stay."""
    floor = (action == "deny") & (F.array_join(policy_ids, ",") == "default-deny")
    return F.when(monitor & (floor | ((action == "approve") & (descriptor != "Drifted"))), "observe-allow").otherwise(action)


def decision_class_of_event(event_type: Column, payload: Column) -> Column:
    """By the payload's decision, else by the ending of the type."""
    told = F.lower(F.get_json_object(payload, "$.decision"))
    ends = lambda *xs: reduce(lambda a, b: a | b, [event_type.endswith("." + x) for x in xs])
    by_type = F.when(ends("created"), "approve").when(ends("leak"), "deny").when(ends("drift", "opened"), "monitor").when(ends("denied", "rejected", "failed", "abandoned"), "deny").otherwise("allow")
    return F.when(told == "block", "deny").when(told.isin("allow", "approve", "deny", "monitor"), told).otherwise(by_type)


def decision_class_of_type(event_type: Column) -> Column:
    """The overview's own mapping; null where it counts nothing."""
    return (
        F.when(event_type.startswith("tool_call.executed") | event_type.startswith("tool_call.opened") | (event_type == "tool_call.decided"), "allow").when(event_type == "approval.created", "approve")
        .when(event_type.endswith(".denied") | event_type.endswith(".rejected") | event_type.contains("drift_rejected") | event_type.contains("secret"), "deny").when(event_type.contains("drift"), "monitor")
    )


def jwt_error(token: Column, resource: str, scopes: list[str], now: int) -> Column:
    """Why an access token can't be used for a resource and scopes, or null."""
    parts = F.split(token, r"\.", -1)
    body = F.try_to_binary(F.translate(F.get(parts, F.lit(1)), "-_", "+/"), F.lit("base64")).cast("string")
    claims = F.when(F.try_parse_json(body).isNotNull(), body)
    res, exp = F.get_json_object(claims, "$.resource"), F.get_json_object(claims, "$.exp").cast("long")
    aud = F.coalesce(F.from_json(F.get_json_object(claims, "$.aud"), "array<string>"), F.array_compact(F.array(F.get_json_object(claims, "$.aud"))))
    granted = F.split(F.coalesce(F.get_json_object(claims, "$.scope"), F.lit("")), " ")
    missing = F.array_except(F.array(*[F.lit(s) for s in scopes]).cast("array<string>"), granted)
    fits = F.when(res.isNotNull(), res == resource).otherwise(F.array_contains(aud, resource))
    return F.when(F.size(parts) != 3, "unsupported_format").when(claims.isNull(), "decode_failed").when(~fits, "audience_mismatch").when(exp <= now, "expired").when(F.size(missing) > 0, "scope_missing")


def sse_payloads(text: Column) -> Column:
    """The data of each event of a server-sent stream."""
    events = F.split(F.regexp_replace(text, "\r\n", "\n"), "\n\n+")
    line = lambda x: F.regexp_replace(F.substring(x, 6, 1 << 30), "^ ", "")
    data = lambda e: F.filter(F.split(e, "\n"), lambda x: x.startswith("data:"))
    return F.transform(F.filter(F.transform(events, data), lambda d: F.size(d) > 0), lambda d: F.array_join(F.transform(d, line), "\n"))


#: Bytes that a hook's input may have.
HOOK_LIMIT = 16 << 20


def hook_event(raw: Column) -> Column:
    """(session_id, cwd, tool_name, tool_input) of a hook's JSON in any known dialect; null for
    input of more than `HOOK_LIMIT` bytes, which callers deny."""
    first = lambda *ks: F.coalesce(*[F.get_json_object(raw, f"$.{k}") for k in ks])
    found = F.struct(first("session_id", "sessionId").alias("session_id"), first("cwd", "working_directory", "workingDirectory").alias("cwd"), first("tool_name", "toolName", "tool").alias("tool_name"), first("tool_input", "toolInput", "input", "arguments", "args").alias("tool_input"))
    return F.when(F.octet_length(raw) <= HOOK_LIMIT, found)
