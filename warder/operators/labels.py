"""File labels: index, queries, spec matching and relabel plans."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from warder.functions import mls
from warder.functions.predicates import candidates, extended_regex, label_text

#: Kind flags of label specs (fixed values).
KINDS = {"--": "file", "-d": "dir", "-l": "lnk_file", "-b": "blk_file", "-c": "chr_file", "-p": "fifo_file", "-s": "sock_file"}
DIMENSIONS = {"users": "user_name", "roles": "role", "types": "type", "ranges": "rng", "devs": "dev"}
VERSION = 2


@dataclass
class LabelSearch:
    """AND of the fields given; ``regex`` holds for all strings; ``relation`` compares the range."""

    user: str | None = None
    role: str | None = None
    type: str | None = None
    range: str | None = None
    obj_class: str | None = None
    path: str | None = None
    dev: str | None = None
    inode: int | None = None
    regex: bool = False
    relation: str | None = None
    type_indirect: bool = False


def read_label_specs(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Spec lines of several files: origin, line_no, path_regex, kind, context. Comments and blanks
    go; a line that is no spec has ``bad`` set. line_no is the place within a file's partition
    order and only orders lines of one file."""
    lines = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("origin"), F.posexplode(F.split("value", "\n")).alias("line_no", "line"))
    return parse_label_specs(lines)


def parse_label_specs(lines: DataFrame) -> DataFrame:
    part = lambda i: F.nullif(F.regexp_extract("line", r"^\s*(\S+)\s+(?:(-\S+)\s+)?(\S+)\s*$", i), F.lit(""))
    rows = lines.filter(~F.col("line").rlike(r"^\s*(#.*)?$")).select("origin", "line_no", part(1).alias("path_regex"), part(2).alias("kind"), part(3).alias("context"))
    good = F.col("path_regex").isNotNull() & (F.col("kind").isNull() | F.col("kind").isin(list(KINDS))) & ((F.col("context") == "<<none>>") | F.col("context").rlike(r"^[^:\s]+:[^:\s]+:[^:\s]+(:\S+)?$"))
    return rows.withColumn("bad", ~F.coalesce(good, F.lit(False)))


def label_search(s: LabelSearch, types: DataFrame | None = None, type_attr: DataFrame | None = None) -> Column:
    """The test on a flat inventory, without the indirect type."""
    test = label_text(F.col("user_name"), s.user, s.regex) & label_text(F.col("role"), s.role, s.regex) & label_text(F.col("path"), s.path, s.regex) & label_text(F.col("dev"), s.dev, s.regex)
    if not s.type_indirect:
        test = test & label_text(F.col("type"), s.type, s.regex)
    if s.range and s.relation:
        test = test & F.coalesce(mls.range_compare(mls.parse_range(F.col("rng")), mls.parse_range(F.lit(s.range)), s.relation), F.lit(False))
    else:
        test = test & label_text(F.col("rng"), s.range, s.regex)
    if s.obj_class and s.obj_class != "any":
        test = test & (F.col("obj_class") == s.obj_class)
    if s.inode is not None:
        test = test & (F.col("inode") == s.inode)
    return test


def query_labels(labels: DataFrame, s: LabelSearch, types: DataFrame | None = None, type_attr: DataFrame | None = None) -> DataFrame:
    """Rows of a flat inventory; a type may be looked up through the policy. Order by path with
    ``sort_labels_by_path``."""
    rows = labels.filter(label_search(s))
    if s.type and s.type_indirect:
        near = candidates(types, type_attr, s.type, regex=s.regex, indirect=True).select("type").distinct()
        rows = rows.join(near, "type", "left_semi")
    return rows


def sort_labels_by_path(rows: DataFrame) -> DataFrame:
    return rows.orderBy("path")


def labels_of_type(labels: DataFrame, type_attr: DataFrame, name: str) -> DataFrame:
    """Files labelled with a type, or with any type of an attribute."""
    near = type_attr.filter(F.col("attr") == name).select("type").distinct()
    member = labels.join(near, "type", "left_semi")
    return labels.filter(F.col("type") == name).unionByName(member).distinct()


def associate_policy(labels: DataFrame, hosts: DataFrame) -> DataFrame:
    """Bind labels to the policy of their host; ``hosts``: host, policy_id."""
    return labels.join(hosts.select("host", "policy_id"), "host", "left")


def build_label_index(labels: DataFrame) -> dict[str, DataFrame]:
    """Star schema: a dictionary for each of user, role, type, range and device, the fact
    ``paths`` with their ids, and ``info`` per host. Ids are hashes of the values, so no value
    waits for a rank of all others."""
    index = {name: labels.select(F.col(c).alias("name")).filter("name is not null").distinct().select(F.xxhash64("name").alias("id"), "name") for name, c in DIMENSIONS.items()}
    ids = [F.when(F.col(c).isNotNull(), F.xxhash64(c)).alias(f"{name[:-1]}_id") for name, c in DIMENSIONS.items()]
    index["paths"] = labels.select("host", "path", "inode", "obj_class", *([F.col("symlink_target")] if "symlink_target" in labels.columns else []), *ids)
    index["info"] = labels.groupBy("host").agg(F.bool_or(F.col("rng").isNotNull()).alias("mls"), F.count(F.lit(1)).alias("files")).withColumns({"version": F.lit(VERSION), "created": F.current_timestamp()})
    return index


def save_label_index(index: dict[str, DataFrame], path: str) -> None:
    for name, table in index.items():
        writer = table.write.partitionBy("host") if name == "paths" else table.write
        writer.parquet(f"{path}/{name}")


def open_label_index(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in [*DIMENSIONS, "paths", "info"]}


def index_rows(index: dict[str, DataFrame], s: LabelSearch | None = None) -> DataFrame:
    """The flat inventory of an index. String predicates are put to the dictionaries first, so
    the fact is joined with what is left of them."""
    s = s or LabelSearch()
    tests = {"users": s.user, "roles": s.role, "types": None if s.type_indirect else s.type, "devs": s.dev, "ranges": None if s.relation else s.range}
    rows = index["paths"]
    for name, c in DIMENSIONS.items():
        table = index[name].select(F.col("id").alias(f"{name[:-1]}_id"), F.col("name").alias(c))
        if tests[name]:
            rows = rows.join(table.filter(label_text(F.col(c), tests[name], s.regex)), f"{name[:-1]}_id")
        else:
            rows = rows.join(table, f"{name[:-1]}_id", "left")
    return rows.drop(*[f"{n[:-1]}_id" for n in DIMENSIONS])


def query_label_index(index: dict[str, DataFrame], s: LabelSearch, types: DataFrame | None = None, type_attr: DataFrame | None = None) -> DataFrame:
    return query_labels(index_rows(index, s), s, types, type_attr)


def upgrade_label_index(old: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Version 1 (paths nested in ``inodes``, no role and device) to version 2."""
    flat = old["inodes"].select("*", F.explode("paths").alias("p")).select("host", F.col("p.path").alias("path"), "inode", F.col("p.symlink_target").alias("symlink_target"), "obj_class", "user_name", "type", "rng")
    return build_label_index(flat.withColumns({"role": F.lit("object_r"), "dev": F.lit("unknown")}))


def label_index_info(index: dict[str, DataFrame]) -> DataFrame:
    return index["info"].select("host", "version", "created", "mls", "files")


def entry_text(labels: DataFrame) -> DataFrame:
    """``path<TAB>context``."""
    context = F.concat_ws(":", "user_name", "role", "type", "rng")
    return labels.withColumn("text", F.concat("path", F.lit("\t"), context))


def query_label_specs(specs: DataFrame, s: LabelSearch, types: DataFrame | None = None, type_attr: DataFrame | None = None) -> DataFrame:
    """Specs by context fields, class (absent on either side matches) and path: the stored
    regex, anchored, is tried on the path asked for."""
    parts = F.split("context", ":", 4)
    rows = specs.withColumns({"user_name": F.get(parts, F.lit(0)), "role": F.get(parts, F.lit(1)), "type": F.get(parts, F.lit(2)), "rng": F.get(parts, F.lit(3)), "obj_class": spec_class()})
    test = label_text(F.col("user_name"), s.user, s.regex) & label_text(F.col("role"), s.role, s.regex) & label_text(F.col("rng"), s.range, s.regex)
    if not s.type_indirect:
        test = test & label_text(F.col("type"), s.type, s.regex)
    if s.obj_class and s.obj_class != "any":
        test = test & (F.col("obj_class").isNull() | (F.col("obj_class") == s.obj_class))
    rows = rows.filter(test)
    if s.path:
        rows = rows.withColumn("__path", F.lit(s.path)).filter(F.expr("__path RLIKE concat('^(?:', path_regex, ')$')")).drop("__path")
    if s.type and s.type_indirect:
        rows = rows.join(candidates(types, type_attr, s.type, regex=s.regex, indirect=True).select("type").distinct(), "type", "left_semi")
    return rows


def spec_class() -> Column:
    out = F.lit(None).cast("string")
    for flag, name in KINDS.items():
        out = F.when(F.col("kind") == flag, name).otherwise(out)
    return out


#: A path component of letters that stand for themselves.
COMPONENT = re.compile(r"/((?:[A-Za-z0-9_\-~,:@%=]|\\[^A-Za-z0-9])+)")


def closes_at_end(pattern: str) -> bool:
    """Whether a pattern that begins with ``(`` is one group with at most a quantifier after it."""
    depth, in_set = 0, False
    for i, c in enumerate(pattern):
        if i and pattern[i - 1] == "\\" and (i < 2 or pattern[i - 2] != "\\"):
            continue
        if in_set:
            in_set = c != "]"
        elif c == "[":
            in_set = True
        elif c in "()":
            depth += 1 if c == "(" else -1
            if not depth:
                return re.fullmatch(r"[?*+]?", pattern[i + 1 :]) is not None
    return False


def literal_stem(pattern: str) -> str:
    """The longest run of whole path components that every path matching the (anchored) pattern
    begins with; '' if there is none."""
    parts, at = [], 0
    if "|" in re.sub(r"\([^()]*\)", "", pattern):  # a choice of whole paths
        return ""
    while m := COMPONENT.match(pattern, at):
        rest = pattern[m.end() :]
        if rest and not re.match(r"/(?![?*{])", rest) and not (rest.startswith("(/") and closes_at_end(rest)):
            break
        parts.append(re.sub(r"\\(.)", r"\1", m.group(1)))
        at = m.end()
    return "".join(f"/{p}" for p in parts)


#: Label specs that an inventory is held against: the bound of what is read by the driver
#: (to translate their patterns) and broadcast.
MOST_SPECS = 100_000


def spec_candidates(labels: DataFrame, specs: DataFrame) -> DataFrame:
    """The files with every spec (line_no, spec, spec_class, spec_context) that may match them.

    Specs (line_no, path_regex, kind, context), at most MOST_SPECS definitions, hang in a trie
    of literal stems of any depth. A file looks up the stems on its own way down the tree of
    paths, one equality join for all of them, so it meets the specs of its folders only,
    however many others there are below the same first folder.
    """
    spark = labels.sparkSession
    given = specs.select("line_no", "path_regex", "kind", "context").limit(MOST_SPECS + 1).collect()
    if len(given) > MOST_SPECS:
        raise ValueError(f"more than {MOST_SPECS} label specs")
    rows = [(n, f"^(?:{extended_regex(p)})$", KINDS.get(k), c, literal_stem(p)) for n, p, k, c in given]
    table = F.broadcast(spark.createDataFrame(rows, "line_no int, spec string, spec_class string, spec_context string, stem string"))
    deepest = max((stem.count("/") for *_, stem in rows), default=0)
    parts = F.split("path", "/")
    down = F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(deepest + 1))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return labels.withColumn("stem", F.explode(F.array_distinct(down))).join(table, "stem").drop("stem")


def expected_labels(labels: DataFrame, specs: DataFrame) -> DataFrame:
    """For every file the spec that holds and whether its label differs.

    Candidates come from ``spec_candidates``. Of the specs that match the last in order holds.
    ``<<none>>`` asks for no label. Files no spec matches have no expectation.
    """
    hit = spec_candidates(labels, specs).filter(F.expr("path RLIKE spec") & (F.col("spec_class").isNull() | (F.col("spec_class") == F.col("obj_class"))))
    best = hit.groupBy("host", "path", "inode", "dev", "user_name", "role", "type", "rng", "obj_class").agg(F.max(F.struct("line_no", "spec_context")).alias("s"))
    actual = F.concat_ws(":", "user_name", "role", "type", F.split("rng", "-")[0])
    return best.select("host", "path", "inode", F.col("s.line_no").alias("line_no"), F.col("s.spec_context").alias("expected"), actual.alias("actual"), ((F.col("s.spec_context") != "<<none>>") & (F.col("s.spec_context") != actual)).alias("mismatch"))


def plan_relabel(labels: DataFrame, s: LabelSearch, user: str | None = None, role: str | None = None, type_: str | None = None, range_: str | None = None) -> DataFrame:
    """(host, path, old, new) for the rows of a search: each field given replaces the old one."""
    old = F.concat_ws(":", "user_name", "role", "type", "rng")
    new = F.concat_ws(":", *[F.lit(v) if v else F.col(c) for v, c in ((user, "user_name"), (role, "role"), (type_, "type"), (range_, "rng"))])
    return query_labels(labels, s).select("host", "path", old.alias("old"), new.alias("new")).filter("old <> new")


def label_counts(labels: DataFrame) -> DataFrame:
    """Files by type with their place by number."""
    n = labels.groupBy("type").agg(F.count(F.lit(1)).alias("files"))
    return n.withColumn("place", F.rank().over(Window.orderBy(F.desc("files"))))
