"""Queries over ordered lines, sinks, stages, event streams and state machines."""

from __future__ import annotations

import contextlib

import pyarrow as pa
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import classify as C
from millrace.operators import bins, lexers, repair, sequence
from millrace.plans import machine
from millrace.plans.by_rule import RANK
from millrace.plans.catalog import query
from millrace.sources import records, sinks
from millrace.streaming import progress

#: Lines of documents, as positions and texts.
LINES = "l AS (SELECT doc_id, CAST(generate_subscripts(s, 1) AS BIGINT) - 1 AS pos, unnest(s) AS line FROM (SELECT doc_id, string_split(regexp_replace(text, '\\r?\\n$', ''), chr(10)) AS s FROM documents WHERE text <> ''))"


def _lines(t):
    return records.numbered(t.documents, "doc_id", "text").withColumn("pos", F.col("pos").cast("bigint"))


def _marked(t):
    """Lines of which those that begin with a capital T stand for boundaries of a program."""
    line = F.when(F.col("line").startswith("T"), F.concat(F.lit("def "), F.regexp_replace("line", "[^A-Za-z]", ""), F.lit("(x):"))).otherwise(F.concat(F.lit("# "), "line"))
    return _lines(t).select(F.col("doc_id").alias("path"), "pos", line.alias("line"), F.lit("python").alias("lang"))


SPANS = f"""WITH {LINES}, m AS (SELECT doc_id AS path, pos, CASE WHEN starts_with(line, 'T') THEN concat('def ', regexp_replace(line, '[^A-Za-z]', '', 'g'), '(x):') ELSE concat('# ', line) END AS line, starts_with(line, 'T') AS hit FROM l),
    c AS (SELECT *, sum(strlen(line) + 1) OVER (PARTITION BY path ORDER BY pos) - strlen(line) - 1 AS before, sum(strlen(line) + 1) OVER (PARTITION BY path) AS every, max(pos) OVER (PARTITION BY path) + 1 AS n FROM m),
    s AS (SELECT path, pos, coalesce(lead(pos) OVER w, n) AS stop, regexp_extract(line, '^def ([^(]*)', 1) AS symbol, CAST(ceil((coalesce(lead(before) OVER w, every) - before - 1) / 4.0) AS BIGINT) AS tokens FROM c WHERE hit WINDOW w AS (PARTITION BY path ORDER BY pos))"""


@query("w01_spans", f"{SPANS} SELECT path, pos, stop, symbol, tokens FROM s")
def _(t):
    return sequence.spans(_marked(t)).withColumnRenamed("end", "stop")


BINS = SPANS.replace("WITH ", "WITH RECURSIVE ", 1) + """, r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY pos) AS k FROM s),
    b AS (SELECT path, pos, tokens, k, CAST(0 AS BIGINT) AS bin, tokens AS used FROM r WHERE k = 1 UNION ALL
    SELECT r.path, r.pos, r.tokens, r.k, CASE WHEN b.used + r.tokens > 200 THEN b.bin + 1 ELSE b.bin END, CASE WHEN b.used + r.tokens > 200 THEN r.tokens ELSE b.used + r.tokens END FROM b JOIN r ON r.path = b.path AND r.k = b.k + 1)"""


@query("w02_greedy_bins", f"{BINS} SELECT path, pos, tokens, bin FROM b")
def _(t):
    return bins.greedy_bins(sequence.spans(_marked(t)), "path", 200)


@query("w03_preamble", f"""{BINS}, g AS (SELECT path, bin, CAST(sum(tokens) AS BIGINT) AS tokens FROM b GROUP BY 1, 2), p AS (SELECT path, CAST(ceil((sum(strlen(line) + 1) - 1) / 4.0) AS BIGINT) AS pre FROM m JOIN (SELECT path, min(pos) AS f FROM s GROUP BY 1) USING (path) WHERE pos < f GROUP BY 1),
    f AS (SELECT g.*, pre, coalesce(pre, 0) + first(g.tokens) OVER (PARTITION BY path ORDER BY bin) <= 200 AS fits FROM g LEFT JOIN p USING (path)),
    u AS (SELECT path, bin, tokens + CASE WHEN bin = 0 AND fits THEN coalesce(pre, 0) ELSE 0 END AS tokens FROM f UNION ALL SELECT path, -1, pre FROM f WHERE bin = 0 AND NOT fits AND pre IS NOT NULL)
    SELECT path, row_number() OVER (PARTITION BY path ORDER BY bin) - 1 AS bin, tokens FROM u""")
def _(t):
    lines = _marked(t)
    spans = sequence.spans(lines)
    binned = bins.greedy_bins(spans, "path", 200).groupBy("path", "bin").agg(F.sum("tokens").alias("tokens"))
    before = lines.join(spans.groupBy("path").agg(F.min("pos").alias("_first")), "path").filter("pos < _first")
    preambles = before.groupBy("path").agg(F.ceil((F.sum(F.octet_length("line") + 1) - 1) / 4).cast("bigint").alias("tokens"))
    return bins.with_preamble(binned, preambles, "path", 200).withColumn("bin", F.col("bin").cast("bigint"))


@query("w04_line_blocks", f"WITH {LINES} SELECT doc_id, pos // 50 AS block, min(pos) AS first, max(pos) AS last, CAST(sum(strlen(line)) AS BIGINT) AS bytes FROM l GROUP BY 1, 2")
def _(t):
    return sequence.line_blocks(_lines(t), "doc_id", 100)


RUN = "SELECT source, doc_id, strlen(text) AS z, sum(strlen(text)) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS s FROM documents"
for _rule, _where, _bytes in (("before", "s <= 24000", "sum(z)"), ("after", "s - z <= 24000", "least(sum(z), 24000)"), ("cut", "s - z < 24000", "least(sum(z), 24000)")):

    @query(f"w05_budget_{_rule}", f"SELECT source, count(*) AS blocks, CAST({_bytes} AS BIGINT) AS bytes FROM ({RUN}) WHERE {_where} GROUP BY 1")
    def _(t, rule=_rule):
        return sequence.budgeted(t.documents, "source", "doc_id", "text", 24000, rule).withColumn("bytes", F.col("bytes").cast("bigint"))


@query("w05_budget_skip", """WITH RECURSIVE r AS (SELECT source, lang, coalesce(strlen(text), 0) AS z, row_number() OVER (PARTITION BY source ORDER BY lang NULLS FIRST, doc_id) AS k FROM documents),
    f AS (SELECT source, k, lang, CASE WHEN z < 9000 THEN z ELSE 0 END AS used, CASE WHEN z < 9000 THEN 1 ELSE 0 END AS n, CASE WHEN z < 9000 THEN '-' ELSE coalesce(lang, '+') END AS ended FROM r WHERE k = 1
    UNION ALL SELECT r.source, r.k, r.lang, CASE WHEN ok THEN used + z + CASE WHEN used > 0 THEN 1 ELSE 0 END ELSE used END, CASE WHEN ok THEN n + 1 ELSE n END, CASE WHEN ok OR coalesce(r.lang, '+') = ended THEN ended ELSE coalesce(r.lang, '+') END
    FROM (SELECT r.*, f.used, f.n, f.ended, coalesce(r.lang, '+') <> f.ended AND f.used + r.z < 9000 AS ok FROM f JOIN r ON r.source = f.source AND r.k = f.k + 1) r)
    SELECT source, CAST(max_by(n, k) AS BIGINT) AS blocks, CAST(max_by(used, k) AS BIGINT) AS bytes FROM f GROUP BY 1""")
def _(t):
    """The texts of a source by language, all within one budget; a language stops where it would overflow."""
    return sequence.budgeted(t.documents, "source", "doc_id", "text", 9000, "skip", "lang")


CODE = "use x;\npub struct A { a: u8, b: { c } }\nfn private() {}\npub fn go(x: u8) -> u8 {\n  1\n}\npub const N: u8 = 3;\npub enum E {\n  P,\n  Q { r: u8 },\n}"


def _code(t):
    return t.part.select(F.col("p_partkey").cast("string").alias("file"), F.lit(CODE).alias("text"))


@query("w06_brace_blocks", "SELECT CAST(p_partkey AS VARCHAR) AS file, CAST(k AS BIGINT) AS ord, d AS decl FROM part, (VALUES (0, 'pub struct A { a: u8, b: { c } }'), (1, 'pub fn go(x: u8) -> u8'), (2, 'pub const N: u8 = 3;'), (3, concat('pub enum E {', chr(10), '  P,', chr(10), '  Q { r: u8 },', chr(10), '}'))) v(k, d)")
def _(t):
    return sequence.brace_blocks(_code(t)).select("file", F.col("ord").cast("bigint").alias("ord"), "decl")


@query("w07_split_contract", "SELECT CAST(p_partkey AS VARCHAR) AS file, 'pub fn go(x: u8) -> u8' AS signatures FROM part")
def _(t):
    return sequence.split_contract(sequence.brace_blocks(_code(t))).select("file", "signatures")


#: Texts and their statements: brackets, quotes, characters, escapes, nothing, and an end that isn't closed.
STATEMENTS = (
    ("let a = f(1; 2); let b = \";\"; let c = ';'; end", "let a = f(1; 2);|let b = \";\";|let c = ';';|end"),
    ("", ""),
    (";;", ";|;"),
    ("x = {{ a; b }}; y = [1; 2]", "x = {{ a; b }};|y = [1; 2]"),
    ("s = \"\\\";\"; t", "s = \"\\\";\";|t"),
    ("a(; b; c", "a(; b; c"),
    ("c = '\\n'; d<'a>; e", "c = '\\n';|d<'a>;|e"),
    ("  p ;\n q  ; ", "p ;|q  ;"),
)


@query("w08_statements", "SELECT p_partkey, CASE p_partkey % 8 " + " ".join("WHEN {} THEN '{}'".format(k, want.replace("'", "''")) for k, (_, want) in enumerate(STATEMENTS)) + " END AS found FROM part")
def _(t):
    text = F.element_at(F.array(*[F.lit(x) for x, _ in STATEMENTS]), (F.col("p_partkey") % 8 + 1).cast("int"))
    return t.part.select("p_partkey", F.array_join(sequence.statements(text), "|").alias("found"))


#: Texts and the heads of their paths: strings, raw strings, characters, comments, nesting, nothing.
HEADS = (
    ("use std::io; /* no::x */ a::b::c(); let s = \"q::r\"; // z::y\nlet c = ':'; h::f();", "a,h,std"),
    ("", ""),
    ("x.y(z)", ""),
    ("r#\"in::raw\"# + out::er(in_::ner())", "in_,out"),
    ("/* open::a", ""),
    ("crate::a::b :: c; Self ::new()", "crate"),
    ("use a::{b::c, d}; e.f::<g::H>(); x: i::J; pub use j::K", "a,g,j"),
    ("'a' ; '\\'' ; k::v::<T::U>()", "T,k"),
)


@query("w09_path_heads", "SELECT p_partkey, CASE p_partkey % 8 " + " ".join(f"WHEN {k} THEN '{want}'" for k, (_, want) in enumerate(HEADS)) + " END AS heads FROM part")
def _(t):
    text = F.element_at(F.array(*[F.lit(x) for x, _ in HEADS]), (F.col("p_partkey") % 8 + 1).cast("int"))
    return t.part.select("p_partkey", F.array_join(sequence.path_heads(text), ",").alias("heads"))


def _as_code(pairs):
    """Documents' words and marks turned into those of code."""
    code = F.col("text")
    for a, b in pairs:
        code = F.replace(code, F.lit(a), F.lit(b))
    return code


def _as_code_sql(pairs):
    """The same for the checking engine."""
    code = "text"
    for a, b in pairs:
        code = "replace({}, '{}', '{}')".format(code, a.replace("'", "''"), b.replace("'", "''"))
    return code


#: Brackets that close and don't, strings and characters with marks in them, lifetimes, many lines.
STATEMENT_CODE = [(". ", ";\n"), (", ", " { "), (" de ", " } "), (" the ", " } "), (" der ", " } "), (" es ", ' "s;\\"}{" '), (" la ", " '{' "), (" of ", " 'a "), (" und ", " '\\'' "), (" el ", "; pub fn "), (" an ", "; fn ")]
STATEMENT_SQL = _as_code_sql(STATEMENT_CODE)


@query("w08_split_statements", rf"""WITH c AS (SELECT doc_id, regexp_extract_all({STATEMENT_SQL}, '(?s)"(?:\\.|[^"\\])*(?:"|\z)|''\\.[^'']*''|''[^''\\]''|[^"''{{}};]+|.') AS w FROM documents WHERE text <> ''),
    t AS (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM c),
    d AS (SELECT *, sum(CASE w WHEN '{{' THEN 1 WHEN '}}' THEN -1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS depth FROM t),
    n AS (SELECT *, w = ';' AND depth = 0 AS ends, coalesce(sum((w = ';' AND depth = 0)::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n FROM d),
    s AS (SELECT doc_id, CAST(n AS BIGINT) AS statement, regexp_replace(string_agg(CASE WHEN ends THEN '' ELSE w END, '' ORDER BY i), '^\s+|\s+$', '', 'g') AS text FROM n GROUP BY 1, 2)
    SELECT doc_id, statement, CASE WHEN regexp_matches(text, '^(pub )?(async )?fn ') THEN concat(text, ' {{ todo!() }}') ELSE concat(text, ';') END AS text FROM s WHERE text <> ''""")
def _(t):
    """Statements of whole texts as they stand in a skeleton; texts are cut into chunks that any task may read."""
    return lexers.stubs(lexers.statements(t.documents.select("doc_id", _as_code(STATEMENT_CODE).alias("text")), "doc_id", "text"))


#: Paths, members, names of types, comments and strings that hide paths.
HEAD_CODE = [(" de ", "::"), (" the ", "::"), (" der ", "::"), (" la ", "."), (", ", " /* "), (" un ", " */ "), (" of ", " */ "), (" die ", " */ "), (" el ", ' "'), (" an ", ' "'), (" une ", " // "), (". ", ";\n")]
HEAD_SQL = _as_code_sql(HEAD_CODE)


@query("w09_crate_heads", rf"""WITH c AS (SELECT doc_id, regexp_extract_all({HEAD_SQL}, '(?s)//[^\n]*(?:\n|\z)|/\*.*?(?:\*/|\z)|"(?:\\.|[^"\\])*(?:"|\z)|[\pL_][\pL\pN_]*(?:::)?|\S') AS w FROM documents WHERE text <> ''),
    t AS (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM c),
    p AS (SELECT *, coalesce(lag(w) OVER (PARTITION BY doc_id ORDER BY i), '') AS before FROM t)
    SELECT DISTINCT doc_id, w[:-3] AS head FROM p WHERE ends_with(w, '::') AND regexp_matches(w, '^\p{{Ll}}') AND NOT regexp_matches(before, '^(.*::|[:.])$')""")
def _(t):
    return lexers.crate_heads(t.documents.select("doc_id", _as_code(HEAD_CODE).alias("text")), "doc_id", "text")


#: Lines that begin declarations, braces within lines and over them.
BLOCK_CODE = [(", ", " { "), (" de ", " } "), (" the ", " } "), (" und ", " } "), (" la ", " {} "), (". ", ";\n"), ("\nE", "\npub fn E"), ("\nT", "\n  pub struct T"), ("\nD", "\npub async fn D"), ("\nL", "\npub const L"), ("\nS", "\npub trait S")]
BLOCK_SQL = _as_code_sql(BLOCK_CODE)


#: Declarations of a text with what they are closed by.
DECLARED = rf"""WITH RECURSIVE l AS (SELECT doc_id, CAST(generate_subscripts(s, 1) AS BIGINT) AS k, unnest(s) AS line FROM (SELECT doc_id, string_split({BLOCK_SQL}, chr(10)) AS s FROM documents WHERE text <> '')),
    b AS (SELECT *, trim(line) AS bare, regexp_replace(line, '[^{{}}]', '', 'g') AS br FROM l),
    m AS (SELECT *, CAST(2 * length(replace(br, '}}', '')) - length(br) AS BIGINT) AS change, coalesce(list_min([2 * length(replace(br[:i], '}}', '')) - i FOR i IN range(1, length(br) + 1) IF br[i] = '}}']), 1000000) AS least, regexp_matches(bare, '^pub (fn|async fn|struct|enum|trait|type|const|static|mod|impl) ') AS begins, ends_with(bare, ';') AS ended FROM b),
    f AS (SELECT doc_id, k, begins AS inside, CASE WHEN begins THEN 1 ELSE 0 END AS n, change AS depth, CASE WHEN NOT begins THEN NULL WHEN least <= 0 THEN 'b' WHEN ended AND change = 0 THEN 's' END AS closed FROM m WHERE k = 1
    UNION ALL SELECT m.doc_id, m.k, m.inside, m.n, m.was + m.change, CASE WHEN NOT m.inside THEN NULL WHEN m.was + least <= 0 THEN 'b' WHEN ended AND m.was + m.change = 0 THEN 's' END
    FROM (SELECT m.*, (f.inside AND f.closed IS NULL) OR m.begins AS inside, f.n + CASE WHEN NOT (f.inside AND f.closed IS NULL) AND m.begins THEN 1 ELSE 0 END AS n, CASE WHEN f.inside AND f.closed IS NULL THEN f.depth ELSE 0 END AS was FROM f JOIN m ON m.doc_id = f.doc_id AND m.k = f.k + 1) m),
    g AS (SELECT doc_id, CAST(n - 1 AS BIGINT) AS block, string_agg(line, chr(10) ORDER BY k) AS text, max(closed) AS closed, trim(arg_min(line, k)) AS first FROM f JOIN l USING (doc_id, k) WHERE inside GROUP BY 1, 2),
    w AS (SELECT doc_id, block, CASE WHEN regexp_matches(first, '^pub (async )?fn ') THEN 'fn' ELSE 'data' END AS kind, CASE WHEN regexp_matches(first, '^pub (async )?fn ') THEN concat(regexp_replace(regexp_replace(split_part(text, '{{', 1), '^\s+|\s+$', '', 'g'), ';+$', ''), ';') ELSE text END AS decl,
    CASE closed WHEN 's' THEN regexp_replace(first, ';+$', '') ELSE trim(regexp_replace(first, '\{{+$', '')) END AS head FROM g WHERE closed IS NOT NULL)"""


@query("w06_declaration_blocks", f"{DECLARED} SELECT * FROM w")
def _(t):
    """Declarations of whole texts; a text's lines are cut into chunks that any task may read."""
    return lexers.declaration_blocks(t.documents.select("doc_id", _as_code(BLOCK_CODE).alias("text")), "doc_id", "text")


@query("w07_contract_parts", f"{DECLARED} SELECT doc_id, coalesce(string_agg(decl, chr(10) || chr(10) ORDER BY block) FILTER (WHERE kind = 'data'), '') AS data, coalesce(string_agg(decl, chr(10) ORDER BY block) FILTER (WHERE kind = 'fn'), '') AS signatures FROM w GROUP BY 1")
def _(t):
    return lexers.contract_parts(lexers.declaration_blocks(t.documents.select("doc_id", _as_code(BLOCK_CODE).alias("text")), "doc_id", "text"), "doc_id")


_BLOCK_LINES = f"l AS (SELECT doc_id, CAST(generate_subscripts(s, 1) AS BIGINT) - 1 AS pos, unnest(s) AS line FROM (SELECT doc_id, string_split(regexp_replace({BLOCK_SQL}, '\\r?\\n$', ''), chr(10)) AS s FROM documents WHERE text <> ''))"
_PUBLIC = "regexp_matches(trim(line), '^pub (fn|async fn|struct|enum|trait|type|const|static|mod|impl) ')"


@query("r26_public_lines", f"WITH {_BLOCK_LINES} SELECT doc_id, pos, {_PUBLIC} AS public FROM l")
def _(t):
    """Lines of whole texts, of which some declare."""
    lines = records.numbered(t.documents.select("doc_id", _as_code(BLOCK_CODE).alias("text")), "doc_id", "text")
    return lines.select("doc_id", F.col("pos").cast("bigint").alias("pos"), C.declares_public(F.col("line")).alias("public"))


@query("f18_declared_names", f"WITH {_BLOCK_LINES} SELECT doc_id, pos, nullif(string_split_regex(string_split(trim(line), CASE WHEN starts_with(trim(line), 'pub async ') THEN 'pub async fn ' WHEN starts_with(trim(line), 'pub fn') THEN 'pub fn ' WHEN starts_with(trim(line), 'pub s') THEN 'pub struct ' WHEN starts_with(trim(line), 'pub c') THEN 'pub const ' ELSE 'pub trait ' END)[2], '[(<: ]')[1], '') AS name FROM l WHERE {_PUBLIC}")
def _(t):
    """Names that declarations of whole texts declare."""
    lines = records.numbered(t.documents.select("doc_id", _as_code(BLOCK_CODE).alias("text")), "doc_id", "text").filter(C.declares_public(F.col("line")))
    return lines.select("doc_id", F.col("pos").cast("bigint").alias("pos"), T.declared_name(F.trim("line")).alias("name"))


#: Regions that are ended, begun anew, left open or empty; sections with settings, comments and other lines.
REGION_CODE = [("\nE", "\n<<<src=e.go>>>\nE"), ("\nT", "\n<<<end>>>\nT"), ("\nD", "\n// <<<src=d d.go>>> x\n \n<<<end>>>"), (". ", ".\n"), ("\nL", "\n<<<src=l.go>>>\nL")]
SECTION_CODE = [("\nE", "\n[dependencies]\nE"), ("\nT", "\n  [other] x\nT"), (" de ", " = "), (" the ", "="), (" der ", " = "), (". ", ".\n"), ("\nL", "\n # L"), ("\nA", "\n[dependencies.a]\nA")]


def _lines_of(pairs):
    return f"l AS (SELECT doc_id AS file, generate_subscripts(s, 1) AS pos, unnest(s) AS line FROM (SELECT doc_id, string_split(regexp_replace({_as_code_sql(pairs)}, '\\r?\\n$', ''), chr(10)) AS s FROM documents WHERE text <> ''))"


@query("src13_regions_of_texts", f"""WITH {_lines_of(REGION_CODE)}, m AS (SELECT *, nullif(regexp_extract(line, '<<<src=(.+?)>>>', 1), '') AS begins, contains(line, '<<<end>>>') AS ends FROM l),
    r AS (SELECT *, count(begins) OVER (PARTITION BY file ORDER BY pos) AS region FROM m), e AS (SELECT *, min(CASE WHEN ends THEN pos END) OVER (PARTITION BY file, region) AS stop, max(begins) OVER (PARTITION BY file, region) AS path FROM r)
    SELECT file, path, string_agg(line, chr(10) ORDER BY pos) AS body FROM e WHERE region > 0 AND begins IS NULL AND (stop IS NULL OR pos < stop) GROUP BY file, region, path HAVING trim(string_agg(line, '')) <> ''""")
def _(t):
    return records.regions(t.documents.select(F.col("doc_id").alias("file"), _as_code(REGION_CODE).alias("text")))


@query("src18_sections_of_texts", f"""WITH {_lines_of(SECTION_CODE)}, m AS (SELECT *, nullif(regexp_extract(trim(line), '^\\[([^\\]]+)\\]', 1), '') AS head FROM l), n AS (SELECT *, last_value(head IGNORE NULLS) OVER (PARTITION BY file ORDER BY pos) AS section FROM m)
    SELECT file, trim(split_part(line, '=', 1)) AS name FROM n WHERE section = 'dependencies' AND head IS NULL AND contains(line, '=') AND NOT starts_with(trim(line), '#')""")
def _(t):
    return records.section_names(t.documents.select(F.col("doc_id").alias("file"), _as_code(SECTION_CODE).alias("text")), "dependencies")


CANON_CODE = [(" de ", "=True\n"), (" the ", "=False  \n \n"), (" la ", "=Trueish\n"), (". ", ".\n\n  "), (" der ", " False\n")]


@query("f21_canonical_texts", f"SELECT doc_id, array_to_string([CASE WHEN ends_with(x, '=True') THEN concat(x[:-5], 'true') WHEN ends_with(x, '=False') THEN concat(x[:-6], 'false') ELSE x END FOR x IN [trim(y) FOR y IN string_split({_as_code_sql(CANON_CODE)}, chr(10))] IF x <> ''], chr(10)) AS text FROM documents")
def _(t):
    return t.documents.select("doc_id", T.canonical(_as_code(CANON_CODE)).alias("text"))


#: Lines that open, close, hide and turn comments.
COMMENTED = ("x", "a /* b", "c */ d", "// see /* here", "/* a /* b */", "*/ y", "/*/", "/* a */ b /* c", "z */ // */ /*", "a / * b", "s // */", "/**/ /*")


@query("w10_in_comment", f"""WITH {LINES}, m AS (SELECT doc_id, pos, CASE (doc_id * 7 + pos * pos + pos * 5) % 12 {' '.join(f"WHEN {k} THEN '{x}'" for k, x in enumerate(COMMENTED))} END AS line FROM l),
    p AS (SELECT doc_id, pos, coalesce(string_agg(line, chr(10)) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before FROM m)
    SELECT doc_id, pos, contains(regexp_replace(before, '(?s)/\\*.*?\\*/|//[^\\n]*', ' ', 'g'), '/*') AS inside FROM p""")
def _(t):
    line = F.element_at(F.array(*map(F.lit, COMMENTED)), ((F.col("doc_id") * 7 + F.col("pos") * F.col("pos") + F.col("pos") * 5) % 12 + 1).cast("int"))
    return sequence.in_comment(_lines(t).withColumn("line", line), "doc_id").select("doc_id", "pos", "inside")


@query("w11_use_lines_once", f"""WITH {LINES}, m AS (SELECT doc_id, pos, CASE (doc_id + pos * pos) % 7 WHEN 0 THEN 'same' WHEN 1 THEN 'user x' ELSE concat('use a', (doc_id + pos) % 5, ';') END AS x FROM l)
    SELECT doc_id, pos FROM m WHERE NOT starts_with(x, 'use ') OR NOT EXISTS (SELECT 1 FROM m b WHERE b.doc_id = m.doc_id AND b.x = m.x AND b.pos < m.pos)""")
def _(t):
    """Imports repeat at any distance, some indented; other lines repeat, too, and stay."""
    n = (F.col("doc_id") + F.col("pos") * F.col("pos")) % 7
    use = F.concat(F.when(F.col("pos") % 2 == 0, "  ").otherwise(""), F.lit("use a"), ((F.col("doc_id") + F.col("pos")) % 5).cast("string"), F.lit("; "))
    return sequence.use_lines_once(_lines(t).withColumn("line", F.when(n == 0, "same").when(n == 1, "user x").otherwise(use)), "doc_id").select("doc_id", "pos")


@query("w12_new_leaves", "SELECT l_orderkey AS module, l_linenumber AS pos FROM lineitem a WHERE NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_suppkey = a.l_suppkey AND b.l_linenumber < a.l_linenumber) GROUP BY 1, 2")
def _(t):
    from millrace.operators.relate import new_leaves_only

    uses = t.lineitem.select(F.col("l_orderkey").alias("module"), F.col("l_linenumber").alias("pos"), "l_suppkey").groupBy("module", "pos").agg(F.collect_set("l_suppkey").alias("leaves"))
    return new_leaves_only(uses).select("module", "pos")


@query("w13_blank_runs", f"""WITH {LINES}, m AS (SELECT doc_id, pos, (doc_id + pos * pos) % 5 < 3 AS blank FROM l)
    SELECT doc_id, pos FROM (SELECT *, lag(blank) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM m) WHERE NOT (blank AND coalesce(before, false))""")
def _(t):
    """Blank lines in runs of any length, of nothing or of spaces."""
    n = (F.col("doc_id") + F.col("pos") * F.col("pos")) % 5
    return sequence.blank_runs_once(_lines(t).withColumn("line", F.when(n >= 3, "x").when(n == 1, "").otherwise("  ")), "doc_id").select("doc_id", "pos")


@query("w14_attribute_above", f"""WITH {LINES}, m AS (SELECT doc_id, pos, (doc_id + pos * pos) % 4 < 3 AS told FROM l)
    SELECT doc_id, pos, (SELECT concat('x', max(b.pos)) FROM m b WHERE b.doc_id = m.doc_id AND b.pos < m.pos AND NOT b.told HAVING count(*) > 0) AS above FROM m""")
def _(t):
    """Documentation in runs of any length, also at the beginning."""
    told = (F.col("doc_id") + F.col("pos") * F.col("pos")) % 4 < 3
    line = F.when(told, F.lit("  /// doc")).otherwise(F.concat(F.lit(" x"), F.col("pos").cast("string")))
    return sequence.attribute_above(_lines(t).withColumn("line", line), "doc_id").select("doc_id", "pos", "above")


@query("w15_renumbered", "SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS place FROM documents")
def _(t):
    return sequence.renumbered(t.documents, "source", "doc_id").select("doc_id", F.col("place").cast("bigint").alias("place"))


@query("w16_newest_first", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS place FROM events")
def _(t):
    return sequence.newest_first(t.events.select("event_id", "user_id", "ts"), "user_id", "ts", "event_id").select("event_id", F.col("place").cast("bigint").alias("place"))


@query("snk04_upsert", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'second' WHEN c_custkey % 3 = 0 THEN 'first' ELSE c_mktsegment END AS value FROM customer UNION ALL SELECT -1, 'added'")
def _(t):
    current = t.customer.select("c_custkey", F.lit(0).alias("seq"), F.col("c_mktsegment").alias("value"))
    one = t.customer.filter("c_custkey % 3 = 0").select("c_custkey", F.lit(1).alias("seq"), F.lit("first").alias("value"))
    two = t.customer.filter("c_custkey % 2 = 0").select("c_custkey", F.lit(2).alias("seq"), F.lit("second").alias("value"))
    more = t.spark.createDataFrame([(-1, 1, "added")], current.schema)
    return sinks.upserted(current, one.unionByName(two).unionByName(more), "c_custkey", "seq").select("c_custkey", "value")


@query("snk05_contract_upsert", "SELECT name, max_by(src, pos) AS src FROM items GROUP BY 1")
def _(t):
    empty = t.items.select("name", "pos", "src").limit(0)
    return sinks.upserted(empty, t.items.select("name", "pos", "src"), "name", "pos").select("name", "src")


@query("snk09_summary", "SELECT doc_id AS run_id, concat('{\"run_id\":', doc_id, ',\"translated\":', n_chars % 9, ',\"failed\":', n_chars % 4, ',\"files_total\":', n_chars % 9 + n_chars % 4, '}') AS summary FROM documents")
def _(t):
    return sinks.summary_json(t.documents.select(F.col("doc_id").alias("run_id"), (F.col("n_chars") % 9).alias("translated"), (F.col("n_chars") % 4).alias("failed")))


@query("snk10_next_steps", "SELECT reason, string_agg(name, ',' ORDER BY name) FILTER (WHERE r <= 40) AS shown, greatest(count(*) - 40, 0) AS more FROM (SELECT *, row_number() OVER (PARTITION BY reason ORDER BY name) AS r FROM (SELECT kind AS reason, concat(name, '@', pos) AS name FROM items WHERE contains(src, 'todo!('))) GROUP BY 1")
def _(t):
    todo = t.items.filter(F.col("src").contains("todo!(")).select(F.col("kind").alias("reason"), F.concat("name", F.lit("@"), F.col("pos").cast("string")).alias("name"))
    return sinks.shown_list(todo, "reason", "name")


@query("snk11_insert_line", "SELECT p_partkey AS file, concat('[a]', chr(10), '[dependencies]', chr(10), 'new = 1', chr(10), 'x = ', p_size) AS text FROM part")
def _(t):
    files = t.part.select(F.col("p_partkey").alias("file"), F.concat(F.lit("[a]\n[dependencies]\nx = "), F.col("p_size").cast("string")).alias("text"))
    return sinks.insert_under(records.numbered(files, "file", "text"), "[dependencies]", "new = 1")


@query("snk12_replace_region", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN concat('a', chr(10), '<<<src=f>>>', chr(10), 'new', chr(10), '<<<end>>>', chr(10), 'z') END AS text FROM part")
def _(t):
    text = F.when(F.col("p_partkey") % 2 == 0, F.lit("a\n<<<src=f>>>\nold\n<<<end>>>\nz")).otherwise(F.lit("none"))
    return t.part.select("p_partkey", sinks.replaced_region(text, F.lit("f"), F.lit("new")).alias("text"))


@query("snk01_append_round_trip", "SELECT n_nationkey, n_name FROM nation UNION ALL SELECT n_nationkey, n_name FROM nation")
def _(t):
    from millrace.sources.durable import folder

    path = folder(t.spark, "append")
    nation = t.nation.select("n_nationkey", "n_name")
    sinks.append_json(nation, path)
    sinks.append_json(nation, path)
    return t.spark.read.schema(nation.schema).json(path)


@query("snk02_stage_round_trip", "SELECT o_orderkey, o_totalprice FROM orders")
def _(t):
    """A stage is written, replaced, and a third write fails midway; what is read are the rows of the second."""
    from pyspark.errors import PySparkException

    from millrace.sources.durable import folder

    root = folder(t.spark, "stages")
    sinks.write_stage(t.nation, root, "one")
    sinks.write_stage(t.orders.select("o_orderkey", "o_totalprice"), root, "one")
    with contextlib.suppress(PySparkException):
        sinks.write_stage(t.orders.select(F.when(F.col("o_orderkey") > 5, F.raise_error(F.lit("broke off"))).otherwise(1).alias("o_orderkey")), root, "one")
    assert sinks.stages_done(t.spark, root, ["one", "two"]) == ["one"]
    return sinks.read_stage(t.spark, root, "one").select("o_orderkey", "o_totalprice")


FOLD = """SELECT run_id, max_by(stage, seq) AS stage, count(*) FILTER (WHERE kind = 'file_complete') AS files, count(*) FILTER (WHERE kind = 'compiler_error') AS errors,
    max_by(kind, seq) FILTER (WHERE kind IN ('done', 'failed')) AS ended, count(*) AS events FROM progress GROUP BY 1"""


@query("st04_progress_fold", FOLD)
def _(t):
    return progress.folded(t.progress).select("run_id", "stage", "files", "errors", "ended", "events")


@query("st01_event_stream", FOLD)
def _(t):
    from millrace.sources.durable import folder

    lines = t.progress.select(F.to_json(F.struct("run_id", "seq", "kind", "stage", "ts")).alias("value"))
    inbox = folder(t.spark, "events")
    lines.unionByName(t.spark.createDataFrame([("{broken",), ("",)], "value string")).repartition(3).write.mode("append").text(inbox)
    out = folder(t.spark, "fold")
    stream = progress.folded(progress.stream_files(t.spark, inbox)).select("run_id", "stage", "files", "errors", "ended", "events")
    progress.run_once(stream, folder(t.spark, "state"), lambda df, n: df.write.mode("overwrite").parquet(out), "complete")
    return t.spark.read.parquet(out)


@query("st02_terminal_events", "SELECT run_id, max_by(kind, seq) AS kind FROM progress WHERE kind IN ('done', 'failed') GROUP BY 1")
def _(t):
    return progress.folded(t.progress).filter("ended is not null").select("run_id", F.col("ended").alias("kind"))


@query("st03_unfinished_runs", f"SELECT run_id, 'failed' AS kind, events AS seq FROM ({FOLD}) WHERE ended IS NULL")
def _(t):
    return progress.unfinished(progress.folded(t.progress))


@query("st05_idle_runs", "SELECT run_id FROM progress GROUP BY 1 HAVING count(*) FILTER (WHERE kind IN ('done', 'failed')) = 0 AND epoch(TIMESTAMP '2024-02-01') - epoch(date_trunc('second', max(ts))) > 60")
def _(t):
    return progress.idle(progress.folded(t.progress), "2024-02-01 00:00:00", 60)


@query("st05_watched_stream", """WITH RECURSIVE e AS (SELECT run_id, seq, kind, (epoch_us(ts) // 1000) AS ms, row_number() OVER (PARTITION BY run_id ORDER BY (epoch_us(ts) // 1000), seq) AS k FROM progress), x AS (SELECT 100000000 AS idle, 200000000 AS dead, max(ms) AS stop FROM e),
    f AS (SELECT run_id, k, seq, ms AS last, kind IN ('done', 'failed') AS closed, CASE WHEN kind IN ('done', 'failed') THEN kind END AS said, CAST(NULL AS BIGINT) AS idle_at, CAST(NULL AS BIGINT) AS died_at, CAST(NULL AS BIGINT) AS was FROM e WHERE k = 1
    UNION ALL SELECT run_id, k, CASE WHEN passed THEN was ELSE seq END, CASE WHEN passed THEN since ELSE ms END, passed OR kind IN ('done', 'failed'), CASE WHEN NOT passed AND kind IN ('done', 'failed') THEN kind END, idle_at, died_at, was
    FROM (SELECT *, (was_closed OR died_at IS NOT NULL) AND ms - since <= dead AS passed FROM (SELECT *, coalesce(died_at, since0) AS since FROM
        (SELECT e.run_id, e.k, e.seq, e.kind, e.ms, f.seq AS was, f.closed AS was_closed, f.last AS since0, dead, CASE WHEN NOT f.closed AND e.ms - f.last > idle THEN f.last + idle END AS idle_at, CASE WHEN NOT f.closed AND e.ms - f.last > dead THEN f.last + dead END AS died_at FROM f JOIN e ON e.run_id = f.run_id AND e.k = f.k + 1, x)))),
    l AS (SELECT f.*, stop, idle, dead FROM f, x WHERE NOT closed QUALIFY k = max(k) OVER (PARTITION BY run_id)),
    z AS (SELECT l.* FROM l JOIN (SELECT run_id, max(k) AS k FROM f GROUP BY 1) USING (run_id, k)),
    r AS (SELECT run_id, said AS kind, seq, last AS ms, false AS made_up FROM f WHERE said IS NOT NULL UNION ALL SELECT run_id, 'idle', was, idle_at, true FROM f WHERE idle_at IS NOT NULL UNION ALL SELECT run_id, 'failed', was, died_at, true FROM f WHERE died_at IS NOT NULL
        UNION ALL SELECT run_id, 'idle', seq, last + idle, true FROM z WHERE stop - last > idle UNION ALL SELECT run_id, 'failed', seq, last + dead, true FROM z WHERE stop - last > dead)
    SELECT run_id, kind, seq, ms, made_up FROM r""")
def _(t):
    """Events come in four lots, in the order of their time; each lot is a batch of the stream, and each second one a start of its own."""
    from millrace.sources.durable import folder
    from millrace.streaming import watch

    inbox, out, checkpoint = (folder(t.spark, x) for x in ("events", "reports", "watch"))
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    first, last = t.progress.agg(F.min(ms), F.max(ms)).first()
    lot = F.least(F.lit(3), F.floor((ms - F.lit(first)) * 4 / max((last or 0) - (first or 0), 1)))
    for k in range(4):
        own = t.progress.filter(lot == k).select(F.to_json(F.struct("run_id", "seq", "kind", "stage", "ts")).alias("value"))
        own.repartition(2).write.mode("append").text(inbox)
        if k % 2:
            watch.watch_files(t.spark, inbox, out, checkpoint, 100_000, 200_000, 2)
    return t.spark.read.schema(watch.REPORT).parquet(out).select("run_id", "kind", "seq", F.expr("timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', CAST(at AS timestamp_ntz))").alias("ms"), "made_up")


@query("st08_rate_and_eta", """SELECT run_id, files, round(CASE WHEN e > 0 AND files > 0 THEN files / e END, 9) AS rate, round(least(70.0, 10 + files / 40 * 60), 9) AS percent, round(greatest(0, 40 - files) / CASE WHEN e > 0 AND files > 0 THEN files / e END, 3) AS seconds_left
    FROM (SELECT run_id, count(*) FILTER (WHERE kind = 'file_complete') AS files, epoch(date_trunc('second', max(ts))) - epoch(date_trunc('second', min(ts))) AS e FROM progress GROUP BY 1)""")
def _(t):
    return progress.eta(progress.folded(t.progress), 40).select("run_id", "files", F.round("rate", 9).alias("rate"), F.round("percent", 9).alias("percent"), F.round("seconds_left", 3).alias("seconds_left"))


@query("st09_error_preview", "SELECT event_id, concat('error[E1]', chr(10), 'error: x', chr(10), 'error: y', chr(10), 'a error: ', event_id) AS preview FROM events")
def _(t):
    text = F.concat(F.lit("note\nerror[E1]\nwarn\nerror: x\nerror: y\na error: "), F.col("event_id").cast("string"), F.lit("\nerror: five"))
    return progress.error_preview(t.events.select("event_id", text.alias("text")), "event_id", "text")


def _state_log(t):
    happy = ["StartParsing", "ParseComplete", "ScaffoldComplete", "ChunkAccepted", "ChunkRetry", "TranslationComplete", "VerifyPassed", "OptimizationComplete"]
    n, run = F.col("c_custkey"), F.col("c_custkey") % 4
    steps = F.when(run == 0, F.array(*map(F.lit, happy))).when(run == 1, F.array(*map(F.lit, ["StartParsing", "Fail", "ParseComplete", "Reset"]))).when(run == 2, F.array(*map(F.lit, [*happy[:3], *["ChunkRetry"] * 5]))).otherwise(F.array(*map(F.lit, ["ParseComplete", "StartParsing"])))
    return t.customer.select(n.alias("run_id"), F.posexplode(steps).alias("seq", "event"))


@query("i05_state_machine", "SELECT c_custkey AS run_id, CASE c_custkey % 4 WHEN 0 THEN 'Completed' WHEN 1 THEN 'Idle' WHEN 2 THEN 'Translating' ELSE 'Parsing' END AS state, CAST(CASE c_custkey % 4 WHEN 0 THEN 8 WHEN 1 THEN 3 WHEN 2 THEN 6 ELSE 1 END AS BIGINT) AS accepted, CAST(CASE c_custkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 1 END AS BIGINT) AS rejected FROM customer")
def _(t):
    return machine.replay(_state_log(t))


@query("i06_retry_ceiling", "SELECT c_custkey AS run_id, CAST(2 AS BIGINT) AS rejected FROM customer WHERE c_custkey % 4 = 2")
def _(t):
    """Runs in which the ceiling rejects more than the states alone."""
    log = _state_log(t)
    free = machine.replay(log, 1 << 30).select("run_id", F.col("rejected").alias("anyway"))
    return machine.replay(log).join(free, "run_id").filter("rejected > anyway").select("run_id", "rejected")


@query("i05_illegal_pairs", "SELECT event_id FROM events WHERE NOT (event_id % 3 = 0 AND event_id % 4 = 0 OR event_id % 3 = 1 AND event_id % 4 = 1 OR event_id % 3 <> 2 AND event_id % 4 = 2 OR event_id % 3 = 2 AND event_id % 4 = 3)")
def _(t):
    pick = lambda n, *x: F.element_at(F.array(*map(F.lit, x)), (F.col("event_id") % n + 1).cast("int"))
    log = t.events.select("event_id", pick(3, "Idle", "Parsing", "Failed").alias("state"), pick(4, "StartParsing", "ParseComplete", "Fail", "Reset").alias("event"))
    return machine.illegal_pairs(log).select("event_id")


@query("i02_fixpoint", "SELECT CAST(n AS BIGINT) AS pass, CAST(5 - n AS BIGINT) AS errors FROM range(6) r(n)")
def _(t):
    """Each pass repairs the errors of one of five packages; the sixth changes nothing and is undone."""
    left = t.spark.createDataFrame([(k,) for k in range(5)], "package int")
    seen = [(n, cost) for n, _, cost in machine.fixpoint(left, lambda df: df.filter(F.col("package") > df.agg(F.min("package")).first()[0]), lambda df: df.count())]
    return t.spark.createDataFrame(seen, "pass bigint, errors bigint")


@query("i04_cycle_summary", "SELECT run_id, cycle, count(*) AS errors FROM (SELECT run_id, ord % 3 AS cycle, level FROM diags) WHERE level IN ('error', 'error: internal compiler error') GROUP BY 1, 2")
def _(t):
    return C.errors(t.diags).groupBy("run_id", (F.col("ord") % 3).alias("cycle")).agg(F.count("*").alias("errors"))


@query("i03_accept_or_revert", "SELECT o_orderkey, o_orderkey % 7 < o_custkey % 7 AS kept FROM orders")
def _(t):
    from millrace.operators.verify import repair_accepted

    return t.orders.select("o_orderkey", repair_accepted(F.col("o_custkey") % 7, F.col("o_orderkey") % 7).alias("kept"))


@query("i08_resume_or_reset", "SELECT project, project = 'src1' AS resumed FROM files GROUP BY 1")
def _(t):
    from millrace.sources import tree

    now = tree.fingerprint(t.files)
    stored = now.select("project", F.when(F.col("project") == "src1", F.col("fingerprint")).otherwise(F.lit("old")).alias("_stored"))
    return now.join(stored, "project").select("project", (F.col("fingerprint") == F.col("_stored")).alias("resumed"))


@query("a07_line_tokens", f"WITH {LINES} SELECT doc_id, CAST(sum((strlen(line) + 3) // 4) AS BIGINT) AS tokens FROM l GROUP BY 1")
def _(t):
    return _lines(t).groupBy("doc_id").agg(F.sum(T.tokens_up(F.col("line"))).alias("tokens"))


@query("src04_missing_file", "SELECT 'x' AS source_lang, 'y' AS source_code WHERE false")
def _(t):
    from millrace.sources.durable import folder

    found = records.read_json_lines(t.spark, folder(t.spark, "nowhere"), records.CORPUS, ["source_lang"])
    return found.select("source_lang", "source_code")


@query("src05_seed_table", "SELECT 'go' AS source_lang, 'strings.Split' AS symbol UNION ALL SELECT 'python', 'os.path'")
def _(t):
    from millrace.sources.tree import SEED

    lines = t.spark.createDataFrame([(x,) for x in SEED.splitlines()], "value string")
    entries = records.json_lines(lines, records.CORPUS, ["source_lang", "source_api", "source_code", "target_code", "package", "file", "tier"])
    return entries.select("source_lang", F.explode("source_api").alias("symbol"))


@query("src09_manifest_and_results", "SELECT 'alpha' AS name, 'clean' AS expectation, CAST(0 AS BIGINT) AS errors UNION ALL SELECT 'gamma', 'impossible', 300 UNION ALL SELECT 'omega', NULL, NULL")
def _(t):
    from millrace.sources.durable import folder

    text = '[[repo]]\nname = "alpha"\nexpectation = "clean"\n[[repo]]\nname = "gamma"\nexpectation = "impossible"\n[[repo]]\nname = "omega"\n'
    manifest = records.toml_rows(t.spark, text, "repo", "name string, expectation string")
    path = folder(t.spark, "results")
    t.spark.createDataFrame([('{"crate_name": "alpha", "errors": 0}',), ('{"crate_name": "gamma", "errors": 300}',)], "value string").write.text(path)
    results = t.spark.read.schema("crate_name string, errors bigint").json(path)
    return manifest.join(results.withColumnRenamed("crate_name", "name"), "name", "left")


@query("src10_yaml_cases", "SELECT 'calc' AS spec, 'add' AS name, '1|+|2' AS args, 'normalized' AS cmp_stdout, 'exact' AS cmp_stderr, 'ignore' AS cmp_exit, false AS nondeterministic UNION ALL SELECT 'calc', 'now', '', 'ignore', 'exact', 'exact', true")
def _(t):
    text = "compare: {stdout: normalized}\ncases:\n- name: add\n  args: [1, '+', 2]\n  compare: {exit_code: ignore}\n- name: now\n  nondeterministic: true\n  compare: {stdout: ignore}\n"
    return records.yaml_cases(t.spark, text, "calc").select("spec", "name", F.array_join("args", "|").alias("args"), "cmp_stdout", "cmp_stderr", "cmp_exit", "nondeterministic")


@query("src16_unzip", "SELECT concat('z', n_nationkey) AS archive, 'src/a.txt' AS name, n_name AS content FROM nation")
def _(t):
    import io
    import zipfile

    from millrace.sources import tree

    @F.arrow_udf("binary")
    def packed(texts: pa.Array) -> pa.Array:
        out = []
        for text in texts.to_pylist():
            buffer = io.BytesIO()
            with zipfile.ZipFile(buffer, "w") as z:
                z.writestr("src/a.txt", text)
                z.writestr("../evil.txt", "x")
                z.writestr("__MACOSX/a.txt", "x")
            out.append(buffer.getvalue())
        return pa.array(out, pa.binary())

    archives = t.nation.select(F.concat(F.lit("z"), F.col("n_nationkey").cast("string")).alias("archive"), packed("n_name").alias("content"))
    return tree.unzip(archives).withColumn("content", F.decode("content", "UTF-8"))


@query("snk03_history", "SELECT r_regionkey AS id, r_name AS name FROM region UNION ALL SELECT n_nationkey, n_name FROM nation")
def _(t):
    from millrace.sources.durable import folder

    path = folder(t.spark, "history")
    sinks.append_history(t.region.select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name")), path)
    sinks.append_history(t.nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")), path)
    return t.spark.read.parquet(path)


@query("i07_stages", "SELECT 'two' AS stage, 2 AS before UNION ALL SELECT 'three', 2")
def _(t):
    """Three stages are written and the last two taken back."""
    from millrace.sources.durable import folder

    root, stages = folder(t.spark, "run"), ["one", "two", "three"]
    for stage in stages[:2]:
        sinks.write_stage(t.region, root, stage)
    before = len(sinks.stages_done(t.spark, root, stages))
    sinks.invalidate_from(t.spark, root, stages, "two")
    left = [s for s in stages if s not in sinks.stages_done(t.spark, root, stages)]
    return t.spark.createDataFrame([(s, before) for s in left], "stage string, before int")


@query("i12_dependency_repair", "SELECT DISTINCT doc_id AS file, CAST(1 AS BIGINT) AS removed FROM documents WHERE doc_id % 4 = 2")
def _(t):
    """A log names a dependency that can't be resolved; manifests that set it lose it."""
    log = t.spark.createDataFrame([(1, "error: no matching package named `lib2` found")], "run_id int, line string")
    files = t.documents.select(F.col("doc_id").alias("file"), F.concat(F.lit("a = 1\nlib"), (F.col("doc_id") % 4).cast("string"), F.lit(" = 2")).alias("text"))
    out = C.commented_out(records.numbered(files, "file", "text"), C.unresolvable(log))
    return out.filter(F.col("line").startswith("# removed: ")).groupBy("file").agg(F.count("*").alias("removed"))


#: Dependencies of a document's manifest, and those that no registry has.
MANIFEST = "SELECT doc_id AS file, j AS pos, (doc_id * (j + 1)) % 13 AS lib FROM documents, range(0, 9) AS r(j) WHERE j < doc_id % 9"


@query("i12_dependency_loop", f"""WITH m AS ({MANIFEST}), b AS (SELECT file, lib, count(*) AS lines, row_number() OVER (PARTITION BY file ORDER BY min(pos)) AS k FROM m WHERE lib % 3 = 1 GROUP BY 1, 2)
    SELECT file, CAST(sum(CASE WHEN k <= 2 THEN lines ELSE 0 END) AS BIGINT) AS removed, CAST(max(k) AS BIGINT) > 2 AS left_over FROM b GROUP BY 1""")
def _(t):
    """Each log names the first dependency that it can't find, so a manifest takes a cycle for each, two at most here."""
    number = lambda c: F.regexp_extract(c, "^lib([0-9]+) =", 1).try_cast("int")
    libs = F.transform(F.sequence(F.lit(0), F.lit(8)), lambda j: F.struct(j.cast("bigint").alias("pos"), F.concat(F.lit("lib"), (F.col("doc_id") * (j + 1) % 13).cast("string"), F.lit(' = "1"')).alias("line")))
    manifests = t.documents.select(F.col("doc_id").alias("file"), F.explode(libs).alias("l")).filter("l.pos < file % 9").select("file", "l.pos", "l.line")

    def log_of(lines):
        missing = lines.withColumn("n", number("line")).filter("n % 3 = 1").groupBy("file").agg(F.min_by("n", "pos").alias("n"))
        return missing.select(F.col("file").alias("run_id"), F.concat(F.lit("error: no matching package named `lib"), F.col("n").cast("string"), F.lit("` found")).alias("line"))

    lines, summary = repair.dependencies_repaired(manifests, log_of, 2)
    removed = lines.filter(F.col("line").startswith("# removed: ")).groupBy("file").agg(F.count("*").alias("removed"))
    left = summary.groupBy("file").agg(F.max_by("after", "cycle").alias("after"))
    return removed.join(left, "file").select("file", "removed", (F.col("after") > 0).alias("left_over"))


@query("i04_repair_cycles", f"""WITH e AS (SELECT run_id, ord % 5 AS kind, count(*) AS n FROM diags WHERE {RANK} >= 3 GROUP BY 1, 2), r AS (SELECT *, row_number() OVER w AS cycle, sum(n) OVER (PARTITION BY run_id) - coalesce(sum(n) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, coalesce(max((kind = 3)::INT) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stuck FROM e WINDOW w AS (PARTITION BY run_id ORDER BY n DESC, kind))
    SELECT cycle, run_id, CAST(before AS BIGINT) AS before, CAST(CASE WHEN kind = 3 THEN before + 1 ELSE before - n END AS BIGINT) AS after, kind <> 3 AS kept FROM r WHERE stuck = 0 AND cycle <= 3""")
def _(t):
    """Each cycle mends a run's most frequent kind of error; for one kind that makes it worse, and the run goes back and is given up."""
    errors = C.errors(t.diags).select("run_id", "ord", (F.col("ord") % 5).alias("kind"))

    def mend(rows, issues):
        counts = issues.groupBy("run_id", "kind").agg(F.count("*").alias("n"))
        worst = counts.groupBy("run_id").agg(F.min_by("kind", F.struct(-F.col("n"), "kind")).alias("worst"))
        both = rows.join(worst, "run_id")
        more = both.filter("worst = 3").groupBy("run_id").agg(F.lit(-1).cast("bigint").alias("ord"), F.lit(3).cast("bigint").alias("kind"))
        return both.filter("kind <> worst or worst = 3").select("run_id", "ord", "kind").unionByName(more)

    return repair.repaired(errors, "run_id", lambda rows: rows, mend)[1]
