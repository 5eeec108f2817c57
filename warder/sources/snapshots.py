"""Policy snapshots as tables: declared schemas, one partition a policy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from warder.functions.state import exists

LEVEL = "struct<sens:string,rank:int,cats:array<string>>"
RANGE = f"struct<low:{LEVEL},high:{LEVEL}>"
#: Columns of each relation beside policy_id.
RELATIONS = {
    "types": "type string, is_attr boolean, is_permissive boolean, aliases array<string>",
    "type_attr": "type string, attr string",
    "role_type": "role string, type string",
    "user_role": "user_name string, role string",
    "class_perm": "class string, perm string",
    "common_perm": "common string, perm string",
    "users": f"user_name string, default_level {LEVEL}, range {RANGE}",
    "bools": "bool string, state boolean",
    "conds": "cond_id bigint, expr array<struct<op:string,name:string>>",
    "avrules": "rule_id bigint, kind string, source string, target string, class string, perms array<string>, cond_id bigint, branch boolean, enabled boolean",
    "terules": "rule_id bigint, kind string, source string, target string, class string, default_type string, cond_id bigint, branch boolean, enabled boolean",
    "fn_trans": "source string, target string, class string, default_type string, filename string",
    "role_allow": "source string, target string",
    "role_trans": "source string, target_type string, default_role string",
    "range_trans": f"source string, target string, class string, range {RANGE}",
    "constraints": "class string, perms array<string>, expr array<struct<kind:string,sym:string,op:string,names:array<string>>>",
    "portcon": "proto string, low int, high int, context string",
    "netifcon": "name string, if_context string, msg_context string",
    "nodecon": "proto string, addr string, mask string, context string",
    "isids": "name string, context string",
    "genfscon": "fs string, path string, class string, context string",
    "fs_use": "fs string, behavior string, context string",
}


class SnapshotError(ValueError):
    """A relation is not as declared; the text names its columns."""


def declared(relation: str) -> T.StructType:
    """The columns of a relation, in order; KeyError for one that is not known."""
    return T.StructType([*T.StructType.fromDDL(RELATIONS[relation]).fields, T.StructField("policy_id", T.StringType())])


def checked(relation: str, found: T.StructType) -> None:
    """Raise SnapshotError naming all columns that are missing or of another type."""
    kinds = {f.name.lower(): f.dataType.simpleString() for f in found.fields}
    wrong = []
    for f in declared(relation).fields:
        kind, want = kinds.get(f.name.lower()), f.dataType.simpleString()
        if kind is None:
            wrong.append(f"{f.name} {want} is missing")
        elif kind != want and f.name != "policy_id":
            wrong.append(f"{f.name} is {kind}, not {want}")
    if wrong:
        raise SnapshotError(f"{relation}: {'; '.join(wrong)}")


def write_policy_tables(tables: dict[str, DataFrame], root: str) -> None:
    """Write relations below ``root``, each in folders by policy_id. All are looked at before the
    first is written; policies that are there are replaced, others stay, other columns are left
    out."""
    for relation, df in tables.items():
        checked(relation, df.schema)
    for relation, df in tables.items():
        rows = df.select(*[F.col(f.name).cast(f.dataType) for f in declared(relation).fields])
        rows.write.partitionBy("policy_id").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(f"{root.rstrip('/')}/{relation}")


def read_policy_tables(spark: SparkSession, root: str, relations: list[str] | None = None, policies: list[str] | None = None) -> dict[str, DataFrame]:
    """The relations below ``root``, with their declared columns and policy_id.

    Without ``relations`` all that are there. Folders of policies that a filter on policy_id, or
    ``policies``, leaves out are not listed or read. A relation whose files lack a declared
    column, or have it in another type, raises SnapshotError; columns beyond are not read.
    """
    out = {}
    for relation in relations or RELATIONS:
        path = f"{root.rstrip('/')}/{relation}"
        if not exists(spark, path):
            if relations:
                raise FileNotFoundError(path)
            continue
        parts = [path] if policies is None else [x for p in policies if exists(spark, x := f"{path}/policy_id={p}")]
        if parts:
            checked(relation, spark.read.option("mergeSchema", "true").option("basePath", path).parquet(*parts).schema)
        df = spark.read.schema(declared(relation)).parquet(path)
        out[relation] = df if policies is None else df.filter(F.col("policy_id").isin(policies))
    return out
