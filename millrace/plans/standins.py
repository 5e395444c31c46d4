"""Tables that the queries stand on, made of the driver's tables.

Each is one SELECT that Spark SQL and the checking engine both read, with the tables it needs in braces.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

FOLDERS = ["src/core/", "src/", "lib/util/", "src/tests/unit/", "node_modules/x/", ".git/", "pkg/api/v2/", "src/core/", ""]
STEMS = ["main", "App", "test_model", "index", "Util-2", "schema.generated", "server"]
ENDS = ["py", "ts", "go", "c", "h", "java", "js", "rb", "cs", "txt", "cpp", "PY", "tsx"]
MESSAGES = [
    "cannot find value `x` in this scope", "use of moved value: `name`", "mismatched types", "expected u8, found integer", "`Foo` cannot be sent: Send missing",
    "the trait bound `crate::a::Foo<T>: Clone` is not satisfied", "`Bar` doesn''t implement `Debug`", "missing lifetime specifier", "cannot borrow `v` as mutable", "unused variable: `y`",
    "macro expansion failed", "literal overflow", "non-exhaustive patterns: `None` not covered", "internal compiler error: stop", "await outside of async fn", "something odd",
]


def _case(value: str, options: list[str]) -> str:
    return f"CASE {value} " + " ".join(f"WHEN {k} THEN '{x}'" for k, x in enumerate(options)) + " END"


STANDINS = {
    "files": f"""SELECT doc_id AS ord, source AS project, lang AS natural, text AS content, CAST(octet_length({{bytes}}) AS BIGINT) AS length,
        concat({_case("doc_id % 9", FOLDERS)}, {_case("doc_id % 7", STEMS)}, CASE WHEN doc_id % 7 IN (0, 3) THEN '' ELSE CAST(doc_id % 50 AS STRING) END, '.', {_case("doc_id % 13", ENDS)}) AS path
        FROM {{documents}}""",
    "diags": f"""SELECT user_id % 20 AS run_id, event_id AS ord, concat('src/', {_case("event_id % 5", ["core", "util", "api", "tests", "lib"])}, '/mod.rs') AS file,
        CASE event_type WHEN 'error' THEN 'error' WHEN 'click' THEN 'warning' WHEN 'view' THEN 'note' WHEN 'signup' THEN 'help' ELSE 'error: internal compiler error' END AS level,
        CASE WHEN event_id % 3 = 0 THEN NULL ELSE concat('E', lpad(CAST(event_id * 7 % 800 AS STRING), 4, '0')) END AS code,
        {_case("event_id % 16", MESSAGES)} AS message FROM {{events}}""",
    "manifest": """SELECT concat('repo', CAST(d.doc_id AS STRING)) AS name, CASE d.doc_id % 3 WHEN 0 THEN 'clean' WHEN 1 THEN 'partial' ELSE 'impossible' END AS expectation,
        l.doc_id IS NOT NULL AS ran, CASE WHEN l.doc_id % 11 = 5 THEN NULL ELSE l.quality = 1 END AS clean, CASE WHEN l.doc_id % 11 = 5 THEN NULL ELSE d.n_chars % 97 END AS errors,
        CASE WHEN l.doc_id % 11 = 5 THEN true END AS pipeline_failed, d.n_chars % 13 AS translated, d.n_chars % 13 + d.doc_id % 2 AS total
        FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id""",
    "edges": """SELECT concat('o', CAST(o_orderkey AS STRING)) AS src, concat('c', CAST(o_custkey AS STRING)) AS dst, o_orderkey AS ord FROM {orders}
        UNION ALL SELECT concat('c', CAST(c_custkey AS STRING)), concat('n', CAST(c_nationkey AS STRING)), 100000000 + c_custkey FROM {customer}
        UNION ALL SELECT concat('n', CAST(n_nationkey AS STRING)), concat('r', CAST(n_regionkey AS STRING)), 200000000 + CAST(n_nationkey AS BIGINT) FROM {nation}""",
    "progress": """SELECT user_id AS run_id, event_id AS seq, ts, CASE event_type WHEN 'error' THEN 'compiler_error' WHEN 'click' THEN 'file_complete' WHEN 'view' THEN 'state_changed' WHEN 'signup' THEN 'note' ELSE CASE WHEN event_id % 50 = 0 THEN 'done' WHEN event_id % 50 = 1 THEN 'failed' ELSE 'file_started' END END AS kind,
        CASE event_id % 6 WHEN 0 THEN 'Parsing' WHEN 1 THEN 'Scaffolding' WHEN 2 THEN 'Translating' WHEN 3 THEN 'Verifying' WHEN 4 THEN 'Optimizing' ELSE 'Paused' END AS stage FROM {events}""",
    "items": """SELECT concat('m', CAST(p_size % 7 AS STRING)) AS module, p_partkey AS pos, CASE p_size % 4 WHEN 0 THEN 'struct' WHEN 1 THEN 'fn' WHEN 2 THEN 'enum' ELSE 'type' END AS kind,
        concat('Item_', CAST(p_partkey * 31 % 400 AS STRING)) AS name, CASE WHEN p_partkey % 9 = 0 THEN 'test' END AS cfg,
        concat(CASE WHEN p_partkey % 5 = 0 THEN '/// doc ' ELSE '' END, CASE WHEN p_partkey % 3 = 0 THEN 'todo!()' ELSE p_type END, CASE WHEN p_partkey % 6 = 1 THEN p_brand ELSE '' END) AS src FROM {part}""",
    "cases": """SELECT concat('spec', CAST(c_nationkey AS STRING)) AS spec, c_name AS name, c_custkey % 10 = 3 AS nondeterministic,
        CASE c_custkey % 4 WHEN 0 THEN 'ignore' WHEN 1 THEN 'normalized' ELSE 'exact' END AS cmp_stdout, CASE c_custkey % 3 WHEN 0 THEN 'ignore' ELSE 'exact' END AS cmp_stderr, CASE c_custkey % 5 WHEN 0 THEN 'ignore' ELSE 'normalized' END AS cmp_exit,
        CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE concat(c_mktsegment, ' id=', CAST(c_custkey AS STRING), '  ', chr(10), 'end') END AS want_stdout, CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE 'warn' END AS want_stderr, CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE c_custkey % 2 END AS want_exit,
        concat(c_mktsegment, ' id=', CAST(CASE WHEN c_custkey % 7 = 0 THEN c_custkey + 1 ELSE c_custkey END AS STRING), CASE WHEN c_custkey % 2 = 0 THEN '  ' ELSE '' END, chr(10), 'end') AS got_stdout, CASE WHEN c_custkey % 6 = 0 THEN 'other' ELSE 'warn' END AS got_stderr, CASE WHEN c_custkey % 13 = 0 THEN 9 ELSE c_custkey % 2 END AS got_exit FROM {customer}""",
}

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, or a stand-in over driver tables."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = STANDINS[name].replace("{bytes}", "text")
    used = {t: load(spark, sf_dir, t) for t in set(re.findall(r"\{(\w+)\}", sql))}
    return spark.sql(sql, **used)


def oracle(name: str) -> str:
    """The same stand-in for the checking engine, where octet_length takes a blob."""
    return re.sub(r"\{(\w+)\}", r"\1", STANDINS[name].replace("octet_length({bytes})", "strlen(text)"))


def with_standins(sql: str) -> str:
    """A query with the stand-ins it names before it."""
    names = [n for n in STANDINS if re.search(rf"\b{n}\b", sql)]
    heads = ", ".join(f"{n} AS ({oracle(n)})" for n in names)
    if not heads:
        return sql
    own = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", sql, re.I)
    if own:
        return f"WITH {own[1] or ''}{heads}, {sql[own.end() :]}"
    return f"WITH {heads} {sql}"
