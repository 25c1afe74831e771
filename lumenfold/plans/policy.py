"""Policy rules compiled into Columns: any effect of the rule and all its conditions.

The strictest action of the rules that fire wins (deny, approve, allow); with none, the
call is denied. Unknown context keys are errors when rules are compiled, not per row.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.decision import TTL_S, host_matches, summary, under_root
from ..functions.hashing import args_hash

DEFAULT_DENY = "default-deny"


class UnknownContextKey(KeyError):
    """A rule names roots or an allow-list that the context doesn't have."""


@dataclass(frozen=True)
class Context:
    """What rules are judged against. Lists are fixed; the rest are columns of the call."""

    roots: dict[str, list[str]]
    allowlists: dict[str, list[str]]
    effects: Column
    risk: Column
    descriptor: Column
    scopes: Column  # array<string>; null: not asked for
    pii: Column  # map<string,int>: findings by label

    def listed(self, where: dict[str, list[str]], key: str) -> list[str]:
        if key not in where:
            raise UnknownContextKey(key)
        return where[key]


@dataclass(frozen=True)
class Condition:
    op: str
    key: str = ""
    value: object = None

    def column(self, c: Context) -> Column:
        e = c.effects
        if self.op in ("inside", "outside"):
            name, roots = self.value, c.listed(c.roots, self.key)
            if name not in ("paths_read", "paths_write"):
                raise TypeError(f"{self.op} takes paths_read or paths_write")
            paths = e[name]
            if self.op == "inside":
                return (F.size(paths) > 0) & F.forall(paths, lambda p: under_root(p, roots))
            return F.exists(paths, lambda p: ~under_root(p, roots)) if roots else F.lit(False)
        if self.op == "eq":
            if self.key not in ("destructive", "reversible"):
                raise TypeError("eq takes destructive or reversible")
            return e[self.key] == F.lit(bool(self.value))
        if self.op == "host_not_in":
            allowed = c.listed(c.allowlists, self.key)
            return F.exists(e["network_hosts"], lambda h: ~reduce(or_, [host_matches(h, a) for a in allowed], F.lit(False)))
        if self.op == "risk_at_least":
            return c.risk >= self.value
        if self.op == "effect_includes":
            return F.array_contains(e["effects"], self.value)
        if self.op == "descriptor_is":
            return c.descriptor == self.value
        if self.op == "scope_not_in":
            allowed = F.array(*[F.lit(x) for x in c.listed(c.allowlists, self.key)]).cast("array<string>")
            return F.when(c.scopes.isNull(), False).otherwise((F.size(c.scopes) == 0) | (F.size(F.array_except(c.scopes, allowed)) > 0))
        if self.op == "pii_contains":
            return F.coalesce(F.try_element_at(c.pii, F.lit(self.key)), F.lit(0)) >= self.value
        raise ValueError(f"unknown condition {self.op}")


@dataclass(frozen=True)
class Rule:
    id: str
    action: str
    priority: int = 0
    effects: tuple[str, ...] = ()
    conditions: tuple[Condition, ...] = field(default=())

    def column(self, c: Context) -> Column:
        parts = [F.arrays_overlap(c.effects["effects"], F.array(*[F.lit(x) for x in self.effects]))] if self.effects else []
        return F.coalesce(reduce(and_, [*parts, *(x.column(c) for x in self.conditions)], F.lit(True)), F.lit(False))


def _c(op: str, key: str = "", value: object = None) -> Condition:
    return Condition(op, key, value)


# The default rules.
BASE_RULES = [
    Rule("deny-destructive-shell", "deny", 200, ("ExecNative",), (_c("eq", "destructive", True),)),
    Rule("deny-destructive-sql", "deny", 200, ("DbWrite",), (_c("eq", "destructive", True),)),
    Rule("deny-outside-project", "deny", 150, ("FsWrite",), (_c("outside", "project_roots", "paths_write"),)),
    Rule("approve-repo-write", "approve", 80, ("FsWrite",), (_c("inside", "project_roots", "paths_write"),)),
    Rule("approve-unknown-host", "approve", 70, ("NetOutbound",), (_c("host_not_in", "allowed_hosts"),)),
    Rule("approve-comm-send", "approve", 70, ("CommSend", "BrowserSubmit")),
    Rule("approve-secret-use", "approve", 70, ("SecretUse",)),
    Rule("approve-exec-native", "approve", 60, ("ExecNative",)),
    Rule("approve-descriptor-drift", "approve", 140, (), (_c("descriptor_is", value="Drifted"),)),
    Rule("approve-descriptor-first-seen", "approve", 130, (), (_c("descriptor_is", value="FirstSeen"),)),
    Rule("allow-repo-read", "allow", 10, ("FsRead",), (_c("inside", "project_roots", "paths_read"), _c("descriptor_is", value="ApprovedStable"))),
]
PII_RULES = [
    Rule("secret_outbound_network_deny", "deny", 100, (), (_c("pii_contains", "secret", 1), _c("effect_includes", value="NetOutbound"))),
    Rule("secret_shell_exec_deny", "deny", 90, (), (_c("pii_contains", "secret", 1), _c("effect_includes", value="ExecNative"))),
    Rule("email_new_host_approve", "approve", 60, (), (_c("pii_contains", "email", 1), _c("host_not_in", "allowed_hosts"))),
    Rule("secret_email_body_approve", "approve", 55, (), (_c("pii_contains", "secret", 1), _c("effect_includes", value="CommSend"))),
    Rule("multi_pii_firstseen_approve", "approve", 50, (), (_c("pii_contains", "email", 1), _c("pii_contains", "phone", 1), _c("descriptor_is", value="FirstSeen"))),
]
DEFAULT_RULES = BASE_RULES + PII_RULES


def decide(rules: list[Rule], context: Context) -> Column:
    """(action, policy_ids, reasons). Rules that take the reserved id are left out."""
    ordered = sorted((r for r in rules if r.id != DEFAULT_DENY), key=lambda r: (-r.priority, r.id))
    hits = F.array_compact(F.array(*[F.when(r.column(context), F.struct(F.lit(r.id).alias("id"), F.lit(r.action).alias("action"))) for r in ordered]).cast("array<struct<id:string,action:string>>"))
    has = lambda a: F.exists(hits, lambda h: h["action"] == a)
    none = F.size(hits) == 0
    return F.struct(
        F.when(none | has("deny"), "deny").when(has("approve"), "approve").otherwise("allow").alias("action"),
        F.when(none, F.array(F.lit(DEFAULT_DENY))).otherwise(F.transform(hits, lambda h: h["id"])).alias("policy_ids"),
        F.when(none, F.array(F.lit("no rule matched; fail-closed default deny"))).otherwise(F.transform(hits, lambda h: F.concat(F.lit("rule `"), h["id"], F.lit("` → "), F.initcap(h["action"])))).alias("reasons"),
    )


def approval_rows(decided: DataFrame, now: int, ttl: int = TTL_S) -> DataFrame:
    """The approvals that decisions ask for, one for each call whose action is approve.

    decided: decision_id, session_id, server_id, tool_name, args, effects (struct), risk,
    action. An approval is pending until it expires `ttl` seconds after `now`; 0 means at once.
    """
    e = F.col("effects")
    return decided.filter("action = 'approve'").select(
        F.concat(F.lit("approval-"), "decision_id").alias("approval_id"), "decision_id", "session_id", "server_id", "tool_name", args_hash(F.col("args")).alias("args_hash"), F.lit("Pending").alias("status"),
        F.lit(None).cast("string").alias("scope"), F.concat("tool_name", F.lit(" on "), "server_id").alias("title"), summary(F.col("risk"), e).alias("summary"), F.to_json(e).alias("effect_json"), F.lit(now).cast("long").alias("created_at"),
        F.lit(now + ttl).cast("long").alias("expires_at"), F.lit(None).cast("long").alias("resolved_at"), F.lit(None).cast("string").alias("resolved_by"),
    )
