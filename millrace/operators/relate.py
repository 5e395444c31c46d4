"""Joins, aggregates, set operations and duplicate elimination.

No side is broadcast by hint unless its size is fixed by this package; for all others the engine
picks by the sizes it measures. Orders end in a unique column, so results do not depend on how tasks
ran.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import classify as C


def resolved(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Import edges between project files: path, line_no, to.

    Every import proposes files in order, by its language's rules, and the first one that exists
    counts; imports of nothing in the project and of the file itself are left out.
    """
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    under = lambda base, rest: F.when(base == "", rest).otherwise(F.concat(base, F.lit("/"), rest))
    dots = F.length(F.regexp_extract("symbol", "^(\\.*)", 1))
    module = F.replace(F.regexp_replace("symbol", "^\\.+", ""), F.lit("."), F.lit("/"))
    parts = F.filter(F.split(folder, "/"), lambda p: p != "")
    above = F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - F.greatest(dots - 1, F.lit(0)), F.lit(0))), "/")
    files_of = lambda base: F.array(F.concat(under(base, module), F.lit(".py")), under(base, F.concat(module, F.lit("/__init__.py"))))
    python = F.when(dots > 0, files_of(above)).otherwise(F.concat(files_of(folder), files_of(F.lit(""))))
    base = T.lexical_path(under(folder, F.col("symbol")))
    ends = [e for ext in ("ts", "tsx", "mts", "js", "mjs", "cjs", "jsx") for e in (f".{ext}", f"/index.{ext}")]
    script = F.when(F.col("symbol").startswith("."), F.array(base, *[F.concat(base, F.lit(e)) for e in ends]))
    c = F.array(T.lexical_path(under(folder, F.col("symbol"))), T.lexical_path(F.col("symbol")))
    candidates = F.when(F.col("lang") == "python", python).when(F.col("lang").isin("javascript", "typescript"), script).when(F.col("lang").isin("c", "cpp"), c)
    proposed = imports.withColumn("_c", candidates).select("path", "line_no", F.posexplode("_c").alias("_pos", "to"))
    known = files.select(F.col("path").alias("to")).distinct()
    return proposed.join(known, "to").groupBy("path", "line_no").agg(F.min_by("to", "_pos").alias("to")).filter("to <> path")


def between_files(edges: DataFrame) -> DataFrame:
    """Edges (src, dst) without those from a file to itself; an end that is null makes none."""
    return edges.filter("src <> dst")


def with_results(manifest: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """Every row of a manifest with its results, if any; a row with several results comes with each."""
    return manifest.join(results, key, "left")


def inner_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges (src, dst) whose ends are both nodes (path)."""
    a, b = nodes.select(F.col("path").alias("src")).distinct(), nodes.select(F.col("path").alias("dst")).distinct()
    return edges.join(a, "src", "left_semi").join(b, "dst", "left_semi")


def neighbours(edges: DataFrame) -> DataFrame:
    """Per node: how many it depends on and how many depend on it."""
    out = edges.select(F.col("src").alias("node"), F.lit(1).alias("deps"), F.lit(0).alias("importers"))
    back = edges.select(F.col("dst").alias("node"), F.lit(0).alias("deps"), F.lit(1).alias("importers"))
    return out.unionByName(back).groupBy("node").agg(F.sum("deps").alias("deps"), F.sum("importers").alias("importers"))


def left_with(left: DataFrame, right: DataFrame, on: str, defaults: dict[str, object]) -> DataFrame:
    """Left outer join with defaults for what the right side lacks."""
    out = left.join(right, on, "left")
    return out.fillna({k: v for k, v in defaults.items()})


def packages_of(edges: DataFrame, packages: DataFrame) -> DataFrame:
    """Per file: the packages of its own and of what it imports, the own one first: path, package, ord."""
    own = packages.select("path", "package", F.lit(0).alias("ord"))
    imported = edges.select(F.col("src").alias("path"), F.col("dst").alias("_to")).join(packages.select(F.col("path").alias("_to"), "package"), "_to").select("path", "package", F.lit(1).alias("ord"))
    found = own.unionByName(imported).groupBy("path", "package").agg(F.min("ord").alias("ord"))
    order = Window.partitionBy("path").orderBy("ord", "package")
    return found.withColumn("ord", F.row_number().over(order) - 1)


def attributed(diags: DataFrame, roots: DataFrame) -> DataFrame:
    """Errors of each package's root file that aren't about imports: root, errors."""
    at = C.errors(diags).filter(C.not_import(F.col("code")))
    return at.join(roots.select("root", F.concat(F.lit("src/"), "root", F.lit("/mod.rs")).alias("file")), "file").groupBy("root").agg(F.count("*").alias("errors"))


def defined(uses: DataFrame, items: DataFrame) -> DataFrame:
    """Identifiers (use) with their definitions (name, module), one row each.

    Equal definitions are joined as one with their number, and repeated after the join. Uses are dealt
    evenly to as many tasks as shuffles have: their bytes, by which the engine would put tasks
    together, say nothing of the rows that each brings.
    """
    dealt = uses.repartition(int(uses.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    alike = items.groupBy(*items.columns).agg(F.count("*").alias("_n"))
    found = dealt.join(alike, dealt["use"] == alike["name"])
    return found.withColumn("_k", F.explode(F.sequence(F.lit(1).cast("bigint"), "_n"))).drop("_n", "_k")


def of_trait_or_type(wanted: DataFrame, impls: DataFrame) -> DataFrame:
    """Implementations whose trait or type is wanted: two equi-joins, each row once."""
    names = wanted.select("name").distinct()
    by_trait = impls.join(names, impls["trait"] == names["name"], "left_semi")
    by_type = impls.join(names, impls["type"] == names["name"], "left_semi")
    return by_trait.unionByName(by_type).distinct()


def searched(items: DataFrame, impls: DataFrame, symbol: str) -> DataFrame:
    """Items by name, then implementations by trait or type: kind, name, module."""
    a = items.filter(F.col("name") == symbol).select(F.lit("item").alias("kind"), "name", "module")
    b = impls.filter((F.col("trait") == symbol) | (F.col("type") == symbol)).select(F.lit("impl").alias("kind"), F.concat_ws(" for ", "trait", "type").alias("name"), "module")
    return a.unionByName(b)


def unique_module(items: DataFrame) -> DataFrame:
    """Symbols that one module alone defines: name, module."""
    return items.groupBy("name").agg(F.min("module").alias("module"), F.max("module").alias("_last")).filter("module = _last").drop("_last")


def import_targets(leaves: DataFrame, items: DataFrame) -> DataFrame:
    """Import leaves (file, name) with the module to import from: by name, else by its plain form; else null."""
    exact = unique_module(items)
    plain = unique_module(items.select(T.segment_key(F.col("name")).alias("name"), "module")).withColumnRenamed("name", "_key").withColumnRenamed("module", "_plain")
    return leaves.join(exact, "name", "left").withColumn("_key", T.segment_key(F.col("name"))).join(plain, "_key", "left").select("file", "name", F.coalesce("module", "_plain").alias("module"))


def missing_dependencies(heads: DataFrame, declared: DataFrame, stripped: DataFrame, project: DataFrame, registry: DataFrame) -> DataFrame:
    """Packages that are used and known to the registry but neither declared, stripped nor the project's own."""
    key = lambda df: df.select(F.replace("name", F.lit("-"), F.lit("_")).alias("head")).distinct()
    left = heads.select("head").distinct()
    for known in (declared, stripped, project):
        left = left.join(key(known), "head", "left_anti")
    return left.join(registry, "head").select("package").distinct()


def derive_requests(messages: DataFrame) -> DataFrame:
    """Per type: the derivable traits that messages ask for, sorted: type, traits."""
    one = messages.select(F.explode(T.trait_requests(F.col("message"))).alias("r")).select(T.simple_type(F.col("r.type")).alias("type"), T.simple_type(F.col("r.trait")).alias("trait"))
    return one.filter(F.col("type").isNotNull() & F.col("trait").isin(*C.DERIVABLE)).groupBy("type").agg(F.array_sort(F.collect_set("trait")).alias("traits"))


def updated(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """Old rows with the new value where there is one."""
    return old.join(new.select(key, F.col(value).alias("_new")), key, "left").withColumn(value, F.coalesce("_new", value)).drop("_new")


def pending(targets: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Targets that aren't done yet; null keys stay."""
    return targets.join(done.select(key).distinct(), key, "left_anti")


def zipped(left: DataFrame, right: DataFrame, order: str) -> DataFrame:
    """Rows of two tables that have the same place."""
    return left.join(right, order)


def with_defaults(cases: DataFrame, specs: DataFrame, key: str, names: list[str], whole: bool = True) -> DataFrame:
    """Cases with their specification's settings where they have none.

    `whole`: a case that sets anything keeps only its own settings and the general default, else
    settings are merged one by one.
    """
    both = cases.join(specs.select(key, *[F.col(n).alias(f"_{n}") for n in names]), key, "left")
    any_own = F.coalesce(*names).isNotNull()
    pick = lambda n: F.coalesce(n, F.when(~any_own, F.col(f"_{n}")), F.lit("exact")) if whole else F.coalesce(n, f"_{n}", F.lit("exact"))
    return both.withColumns({n: pick(n) for n in names}).drop(*[f"_{n}" for n in names])


def top_by_count(df: DataFrame, key: str) -> DataFrame:
    """The most frequent value; ties go to the first by name."""
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("count")).orderBy(F.desc("count"), key).limit(1)


def singletons(items: DataFrame, key: Column) -> DataFrame:
    """Keys that occur once, with their row: key, name."""
    return items.groupBy(key.alias("key")).agg(F.count("*").alias("_n"), F.first("name").alias("name")).filter("_n = 1").drop("_n")


def best_round(rounds: DataFrame) -> DataFrame:
    """Per run: the round with the fewest issues, the earliest of equals."""
    return rounds.groupBy("run_id").agg(F.min_by("round", F.struct("issues", "round")).alias("round"), F.min("issues").alias("issues"))


def first_of(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """One row per key: the first in order."""
    first = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(first)).filter("_rank = 1").drop("_rank")


def item_key(kind: Column, name: Column, cfg: Column) -> Column:
    """What makes two items the same: kind, name and condition; all type-like kinds are one."""
    return F.concat_ws(" ", F.when(kind.isin("struct", "enum", "union", "type"), "type").otherwise(kind), name, F.coalesce(cfg, F.lit("")))


def best_items(items: DataFrame) -> DataFrame:
    """Items (module, pos, kind, name, cfg, src), of duplicates the best one.

    Best is a real body before a stub, documented, longest, earliest.
    """
    real, documented = ~F.col("src").contains("todo!("), F.trim("src").startswith("///")
    keyed = items.withColumn("_key", item_key(F.col("kind"), F.col("name"), F.col("cfg")))
    return first_of(keyed, ["module", "_key"], [real.desc(), documented.desc(), F.octet_length(F.trim("src")).desc(), F.col("pos")]).drop("_key")


def verbatim_once(items: DataFrame) -> DataFrame:
    """Items of which each text is kept once per module, the earliest."""
    return first_of(items.withColumn("_h", F.sha2("src", 256)), ["module", "_h"], ["pos"]).drop("_h")


def new_leaves_only(uses: DataFrame) -> DataFrame:
    """Import rows (module, pos, leaves) that bring a leaf that no earlier row of the module has."""
    leaves = uses.select("module", "pos", F.explode("leaves").alias("leaf"))
    first = leaves.groupBy("module", "leaf").agg(F.min("pos").alias("pos")).select("module", "pos").distinct()
    return uses.join(first, ["module", "pos"], "left_semi")


def distinct_files(diags: DataFrame) -> DataFrame:
    """Files that errors point at, in the order they appear first: run_id, file, ord."""
    first = C.errors(diags).groupBy("run_id", "file").agg(F.min("ord").alias("_first"))
    order = Window.partitionBy("run_id").orderBy("_first", "file")
    return first.withColumn("ord", F.row_number().over(order)).drop("_first")


def nodes_of(targets: DataFrame, edges: DataFrame) -> DataFrame:
    """Targets and ends of edges, each once, in the order they appear first: path, ord."""
    ends = edges.select(F.col("src").alias("path"), (F.col("ord") * 2 + (1 << 40)).alias("ord")).unionByName(edges.select(F.col("dst").alias("path"), (F.col("ord") * 2 + 1 + (1 << 40)).alias("ord")))
    return targets.select("path", "ord").unionByName(ends).groupBy("path").agg(F.min("ord").alias("ord"))
