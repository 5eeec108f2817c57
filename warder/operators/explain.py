"""Audit messages joined with the policy rules that concern them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from warder.functions.predicates import expand_type


def explain_messages(messages: DataFrame, rules: DataFrame, type_attr: DataFrame) -> DataFrame:
    """For each message the rules of its source type, target type and class.

    Rules over attributes are expanded first; the rule keeps its written source and target.
    The rules of a policy that concern one source, target and class are gathered in a row before
    the join, and handed out behind it: a message is joined once a policy, not once a rule. Only
    the message's keys and the rules' keys are shuffled; a hot pair of types is split by the
    adaptive skew join.
    """
    written = rules.select("policy_id", "rule_id", "kind", "source", "target", "class", F.array_join(F.array_sort("perms"), ",").alias("perms"), F.col("source").alias("rule_source"), F.col("target").alias("rule_target"))
    concrete = expand_type(expand_type(written, "target", type_attr), "source", type_attr)
    keys = [F.col("source").alias("stype"), F.col("target").alias("ttype"), F.col("class").alias("tclass"), "policy_id"]
    told = F.collect_set(F.struct("rule_id", "kind", "rule_source", "rule_target", "perms")).alias("__rules")
    gathered = concrete.groupBy(*keys).agg(told)
    return messages.join(gathered, ["stype", "ttype", "tclass"]).select("*", F.inline("__rules")).drop("__rules")


def unexplained_denials(messages: DataFrame, rules: DataFrame, type_attr: DataFrame) -> DataFrame:
    """Denied messages that no allow rule of their types and class concerns."""
    denied = messages.filter(F.col("decision") == "denied")
    allow = explain_messages(denied, rules.filter("kind = 'allow'"), type_attr).select("msg_id").distinct()
    return denied.join(allow, "msg_id", "left_anti")
