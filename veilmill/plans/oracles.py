"""DuckDB SQL for the registered queries, composed from shared common table expressions."""

from __future__ import annotations

import re

from veilmill.functions import text as tx
from veilmill.operators import noise, wordvecs
from veilmill.operators.draw import MIX
from veilmill.operators.evaluate import METRICS
from veilmill.operators.generate import DEFAULT_EXAMPLES, DEFAULT_SYSTEM
from veilmill.operators.lsh import BANDS, NUM_PERM, PRIME, SEED
from veilmill.operators.privatize import PLACES
from veilmill.operators.sweep import FACTORS
from veilmill.operators.tokens import MAX_LOGIT, MIN_LOGIT
from veilmill.operators.triples import ANCHORS
from veilmill.plans.queries import (
    CELL_BITS, DIM, DRAW_SEED, EPSILON, GAMMA, KMEANS, LM_HIGH, LM_LOW, NOISE_EPSILONS, SIZES, TURNS,
)

STAR_ROUNDS = 8
SPAN = 2**31


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# ---- expression helpers -------------------------------------------------------------------


def uniform(seed: str, *keys: str) -> str:
    joined = ", ".join([lit(seed), *[f"({k})::VARCHAR" for k in keys]])
    return f"((('0x'||substr(md5(concat_ws('|', {joined})),1,13))::BIGINT + 0.5) / 4503599627370496.0)"


def gumbel(seed: str, *keys: str) -> str:
    return f"(-ln(-ln({uniform(seed, *keys)})))"


def laplace(scale: str, seed: str, *keys: str) -> str:
    u = f"({uniform(seed, *keys)} - 0.5)"
    return f"(-({scale}) * sign({u}) * ln(1.0 - 2.0 * abs({u})))"


def normal(scale: str, seed: str, *keys: str) -> str:
    radius = f"sqrt(-2.0 * ln({uniform(seed + '.r', *keys)}))"
    return f"(({scale}) * {radius} * cos(2.0 * pi() * {uniform(seed + '.a', *keys)}))"


def words(text: str) -> str:
    return f"list_transform(regexp_extract_all({text}, '[A-Za-z]+'), lambda w: lower(w))"


def tokens(text: str) -> str:
    return f"regexp_extract_all({text}, '[A-Za-z0-9]+|[^A-Za-z0-9\\s]')"


PUNCT = "(" + ", ".join(lit(c) for c in tx.PUNCTUATION) + ")"


def word_tokens(toks: str) -> str:
    return f"len(list_filter({toks}, lambda t: t NOT IN {PUNCT}))"


def detokenize(toks: str) -> str:
    return f"regexp_replace(array_to_string({toks}, ' '), '\\s+([.,;:!?])', '\\1', 'g')"


def cosine(a: str, b: str) -> str:
    na, nb = f"sqrt(list_inner_product({a}, {a}))", f"sqrt(list_inner_product({b}, {b}))"
    return f"(CASE WHEN {na} * {nb} = 0 THEN 0.0 ELSE list_inner_product({a}, {b}) / ({na} * {nb}) END)"


def unit(vec: str) -> str:
    length = f"sqrt(list_inner_product({vec}, {vec}))"
    return f"(CASE WHEN {length} = 0 THEN {vec} ELSE list_transform({vec}, lambda x: x / {length}) END)"


def mean_vec(vec: str, dim: int) -> str:
    return "[" + ", ".join(f"avg({vec}[{i + 1}])" for i in range(dim)) + "]"


def features(kind: str, text: str) -> str:
    if kind == "word":
        return words(text)
    n = int(kind[-1])
    grams = f"list_transform(range(1, length({text}) - {n - 2}), lambda i: substr({text}, i, {n}))"
    return f"(CASE WHEN length({text}) >= {n} THEN {grams} ELSE []::VARCHAR[] END)"


def parse_ends(triple: str) -> tuple[str, str, str]:
    parts = f"string_split({triple}, ' | ')"
    return tuple(f"CASE WHEN len({parts}) >= 3 THEN {parts}[{i}] END" for i in (1, 2, 3))


def clamp(x: str, low: float = MIN_LOGIT, high: float = MAX_LOGIT) -> str:
    return f"least(greatest({x}, {low}::DOUBLE), {high}::DOUBLE)"


# ---- shared tables ------------------------------------------------------------------------

CTES: dict[str, str] = {}


def cte(name: str, sql: str) -> None:
    CTES[name] = sql.strip()


cte("docs", "SELECT doc_id, text, lang, source FROM documents")
cte("accepted", "SELECT doc_id, text FROM documents WHERE lang = 'en' AND length(text) <= 10000")
cte("accepted_triples", "SELECT t.* FROM triples t JOIN accepted USING (doc_id)")
cte("turns", f"SELECT conv_id * {TURNS} + turn AS doc_id, text, role FROM conversations")
cte("items", "SELECT item_id AS doc_id, text FROM benchmark")


def extraction(prefix: str, source: str) -> None:
    """Triples of a document table: ``<prefix>raw`` as extracted, ``<prefix>triples`` distinct."""
    cte(f"{prefix}sents", f"""
    SELECT doc_id, si, {words('s[si]')} AS w
    FROM (SELECT doc_id, regexp_split_to_array(text, '[.!?\\n|]+') AS s FROM {source}) d,
         unnest(range(1, len(s) + 1)) r(si)
    """)
    anchors = ", ".join(lit(a) for a in ANCHORS)
    cte(f"{prefix}raw", f"""
    SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY si, i, sl, ol) - 1)::INTEGER AS pos,
           array_to_string(w[i - sl : i - 1], ' ') AS subject, w[i] AS relation,
           array_to_string(w[i + 1 : i + ol], ' ') AS object,
           translate(concat_ws(' | ', array_to_string(w[i - sl : i - 1], ' '), w[i],
                     array_to_string(w[i + 1 : i + ol], ' ')), '_', ' ') AS triple
    FROM {prefix}sents, unnest(range(2, len(w))) a(i), (VALUES (1,1),(1,2),(2,1),(2,2)) v(sl, ol)
    WHERE len(w) >= 3 AND w[i] IN ({anchors}) AND i > sl AND i + ol <= len(w)
    """)
    cte(f"{prefix}triples", f"""
    SELECT doc_id, triple,
           (row_number() OVER (PARTITION BY doc_id ORDER BY min(pos)) - 1)::INTEGER AS pos
    FROM {prefix}raw GROUP BY doc_id, triple
    """)


extraction("", "docs")
extraction("item_", "items")

cte("perms", f"""
SELECT i::INTEGER AS i,
       ('0x'||substr(md5('{SEED}|a|'||i),1,8))::BIGINT % {PRIME - 1} + 1 AS a,
       ('0x'||substr(md5('{SEED}|b|'||i),1,8))::BIGINT % {PRIME} AS b
FROM range({NUM_PERM}) r(i)
""")

def near_duplicates(p: str) -> None:
    """Index, degrees and star clusters of the triples ``<p>triples``."""
    cte(f"{p}grams", f"""
    SELECT DISTINCT doc_id, pos, substr(triple, i, 3) AS shingle
    FROM {p}triples, unnest(range(1, length(triple) - 1)) r(i) WHERE length(triple) >= 3
    """)
    cte(f"{p}mins", f"""
    SELECT doc_id, pos, i, min((a * h + b) % {PRIME}) AS m
    FROM (SELECT doc_id, pos, ('0x'||substr(md5(shingle),1,8))::BIGINT % {PRIME} AS h FROM {p}grams) g, perms
    GROUP BY doc_id, pos, i
    """)
    cte(f"{p}bands", f"""
    SELECT doc_id, pos, i // {NUM_PERM // BANDS} AS band, list(m ORDER BY i) AS key FROM {p}mins GROUP BY ALL
    """)
    cte(f"{p}bucket_sets", f"""
    SELECT doc_id, min(band) AS band, members FROM (
      SELECT doc_id, band, key, list(pos ORDER BY pos) AS members
      FROM {p}bands GROUP BY doc_id, band, key HAVING count(*) > 1)
    GROUP BY doc_id, members
    """)
    cte(f"{p}lsh_pairs", f"""
    SELECT DISTINCT a.doc_id, a.pos AS a, b.pos AS b
    FROM {p}bands a JOIN {p}bands b ON a.doc_id = b.doc_id AND a.band = b.band AND a.key = b.key AND a.pos <> b.pos
    """)
    cte(f"{p}degrees", f"SELECT doc_id, a AS pos, count(*) AS degree FROM {p}lsh_pairs GROUP BY doc_id, a")
    cte(f"{p}live0", f"SELECT doc_id, pos, degree * 2147483648 + (2147483647 - pos) AS rank FROM {p}degrees")
    for _r in range(STAR_ROUNDS):
        cte(f"{p}lead{_r}", f"""
        SELECT doc_id, pos FROM {p}live{_r} l WHERE NOT EXISTS (
          SELECT 1 FROM {p}lsh_pairs p JOIN {p}live{_r} o ON o.doc_id = p.doc_id AND o.pos = p.b
          WHERE p.doc_id = l.doc_id AND p.a = l.pos AND o.rank > l.rank)
        """)
        cte(f"{p}live{_r + 1}", f"""
        SELECT * FROM {p}live{_r} l
        WHERE NOT EXISTS (SELECT 1 FROM {p}lead{_r} s WHERE s.doc_id = l.doc_id AND s.pos = l.pos)
          AND NOT EXISTS (SELECT 1 FROM {p}lead{_r} s JOIN {p}lsh_pairs p ON p.doc_id = s.doc_id AND p.a = s.pos
                          WHERE p.doc_id = l.doc_id AND p.b = l.pos)
        """)
    cte(f"{p}seeds", " UNION ALL ".join(f"SELECT doc_id, pos FROM {p}lead{r}" for r in range(STAR_ROUNDS)))
    cte(f"{p}clusters", f"""
    SELECT s.doc_id, s.pos AS seed, p.b AS member
    FROM {p}seeds s JOIN {p}lsh_pairs p ON p.doc_id = s.doc_id AND p.a = s.pos
    """)


near_duplicates("")


def language_model(prefix: str, source: str, k: float = 0.1) -> None:
    cte(f"{prefix}counts", f"""
    SELECT prev, word, count(*) AS n FROM (
      SELECT unnest(list_concat(['<s>'], w[1 : len(w) - 1])) AS prev, unnest(w) AS word
      FROM (SELECT {words('text')} AS w FROM {source}) WHERE len(w) > 0)
    GROUP BY prev, word
    """)
    cte(f"{prefix}vocab", f"SELECT count(DISTINCT word) AS v FROM {prefix}counts")
    cte(f"{prefix}hist", f"""
    SELECT prev, sum(n)::BIGINT AS n_prev,
           round(ln({k} / (sum(n) + {k} * any_value(v))) * 1e9)::BIGINT AS unseen
    FROM {prefix}counts, {prefix}vocab GROUP BY prev
    """)
    cte(f"{prefix}lm", f"""
    SELECT c.prev, c.word, c.n, h.n_prev,
           round(ln((c.n + {k}) / (h.n_prev + {k} * v)) * 1e9)::BIGINT AS logp
    FROM {prefix}counts c JOIN {prefix}hist h USING (prev), {prefix}vocab
    """)


def perplexity(prefix: str, source: str, ids: str) -> str:
    """Perplexity of the ``text`` of ``source``."""
    return f"""
    SELECT {ids}, count(*) AS n_words,
           exp(-sum(coalesce(logp, unseen, round(-ln(v) * 1e9)::BIGINT))::DOUBLE / count(*) / 1e9) AS ppl
    FROM (SELECT {ids}, unnest(list_concat(['<s>'], w[1 : len(w) - 1])) AS prev, unnest(w) AS word
          FROM (SELECT {ids}, {words('text')} AS w FROM {source}) WHERE len(w) > 0) b
    LEFT JOIN {prefix}lm USING (prev, word) LEFT JOIN {prefix}hist USING (prev), {prefix}vocab
    GROUP BY {ids}
    """


language_model("", "docs")

def choice(p: str, source: str, lm: str) -> None:
    """The triples ``<p>survivors``: the best-reading of each cluster of ``<source>triples`` by a model."""
    cte(f"{p}covered", f"""
    SELECT DISTINCT t.doc_id, t.pos, replace(t.triple, ' | ', ' ') AS text
    FROM {source}triples t JOIN {source}clusters c ON c.doc_id = t.doc_id AND c.member = t.pos
    """)
    cte(f"{p}covered_ppl", perplexity(lm, f"{p}covered", "doc_id, pos"))
    cte(f"{p}best", f"""
    SELECT c.doc_id, c.seed, arg_min(c.member, (round(q.ppl, 6), c.member)) AS pos
    FROM {source}clusters c JOIN {p}covered_ppl q ON q.doc_id = c.doc_id AND q.pos = c.member
    GROUP BY c.doc_id, c.seed
    """)
    cte(f"{p}survivors", f"""
    SELECT doc_id, pos, triple FROM {source}triples WHERE (doc_id, pos) IN (SELECT doc_id, pos FROM {p}best)
    """)


choice("", "", "")

# The public side of private rewriting: conversation turns, and a model of them for both sides.
extraction("pub_", "turns")
near_duplicates("pub_")
language_model("pub_", "turns")
choice("pub_", "pub_", "pub_")
choice("own_", "", "pub_")


def hash_vectors(name: str, source: str, ids: str, kind: str = "char3", text: str = "text") -> None:
    """``(ids, vec)``: signed feature counts of a text column, unit length."""
    cte(f"{name}_feats", f"""
    SELECT {ids}, ('0x'||substr(md5(f),1,8))::BIGINT % {DIM} AS d,
           CASE WHEN ('0x'||substr(md5(f),9,1))::BIGINT % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS s
    FROM (SELECT {ids}, unnest({features(kind, text)}) AS f FROM {source})
    """)
    sums = ", ".join(f"coalesce(sum(s) FILTER (d = {i}), 0.0)" for i in range(DIM))
    cte(f"{name}_raw", f"""
    SELECT {ids}, [{sums}]::DOUBLE[] AS raw FROM {name}_feats GROUP BY {ids}
    """)
    zero = "list_value(" + ", ".join(["0.0"] * DIM) + ")::DOUBLE[]"
    cte(f"{name}_vecs", f"""
    SELECT s.*, coalesce({unit('raw')}, {zero}) AS vec
    FROM (SELECT DISTINCT {ids} FROM {source}) s LEFT JOIN {name}_raw USING ({ids})
    """)


cte("triple_texts", "SELECT DISTINCT triple FROM triples")
hash_vectors("tt", "triple_texts", "triple", text="triple")

cte("vecs", """
SELECT vec_id, vec_id // 10 AS doc_id, (vec_id % 10)::INTEGER AS pos, label,
       embedding::DOUBLE[] AS vec FROM embeddings
""")
cte("vecs32", f"""
SELECT vec_id, doc_id, pos, label, {unit(f'vec[1:{DIM}]')} AS vec FROM vecs
""")
cte("label_means", f"""
SELECT label AS cluster_id, {mean_vec('vec', 64)} AS centroid FROM vecs GROUP BY label
""")


def nearest(vecs: str, centroids: str, key: str, metric: str = "cosine", out: str = "cluster_id") -> str:
    score = f"round({cosine('v.vec', 'c.centroid')}, {PLACES})"
    if metric == "euclidean":
        score = "-list_distance(v.vec, c.centroid)"
    return f"""
    SELECT v.{key}, arg_max(c.cluster_id, ({score}, -c.cluster_id))::INTEGER AS {out}
    FROM {vecs} v, {centroids} c GROUP BY v.{key}
    """


def sign_cell(bits: int, vec: str = "vec") -> str:
    return "(" + " + ".join(f"CASE WHEN {vec}[{i + 1}] > 0 THEN {2**i} ELSE 0 END" for i in range(bits)) + ")"


cte("vec_cells", nearest("vecs", "label_means", "vec_id"))


MASK = 2**64 - 1


def half(text: str, which: int) -> str:
    """One half of md5 as an unsigned 64-bit number, held in 128 bits."""
    return f"('0x'||substr(md5({text}),{1 + 16 * which},16))::UBIGINT::UHUGEINT"


def mixed(z: str) -> str:
    steps = (
        f"(xor(z, z >> 30) * {MIX[0]}::UHUGEINT) & {MASK}::UHUGEINT",
        f"(xor(z, z >> 27) * {MIX[1]}::UHUGEINT) & {MASK}::UHUGEINT", "xor(z, z >> 31)",
    )
    out = f"[{z}]"
    for step in steps:
        out = f"list_transform({out}, lambda z: {step})"
    return f"{out}[1]"


def draw(
    name: str, queries: str, members: str, on: str, qkey: str, score: str, seed: str, runs: bool = False,
) -> None:
    """The draw of ``queries`` (alias q) among ``members`` (alias m, id column ``key``): the largest noisy score.

    With ``runs`` the queries have a run, which is part of the key.
    """
    keys = [f"q.{k.strip()}" for k in qkey.split(",")]
    run = "q.run" if runs else "''"
    qkey += ", run" * runs
    qcols = ", ".join(keys + ["q.run"] * runs)
    text = f"concat_ws('|', {lit(seed)}, {run}, {', '.join(f'({k})::VARCHAR' for k in keys)})"
    cte(f"{name}_q", f"SELECT q.*, {half(text, 0)} AS high, {half(text, 1)} AS low FROM {queries} q")
    cte(f"{name}_m", f"SELECT m.*, {half('m.key::VARCHAR', 0)} AS mark FROM {members} m")
    bits = mixed(f"xor({mixed(f'(q.high + m.mark) & {MASK}::UHUGEINT')}, q.low)")
    noise_ = f"(-ln(-ln((({bits} >> 12)::DOUBLE + 0.5) / 4503599627370496.0)))"
    cte(f"{name}_scored", f"SELECT {qcols}, m.key, {score} + {noise_} AS score FROM {name}_q q JOIN {name}_m m USING ({on})")
    cte(f"{name}_drawn", f"""
    SELECT {qkey}, arg_max(key, score) AS key, max(score) AS score FROM {name}_scored GROUP BY {qkey}
    """)


SIMILARITY = f"greatest(round({cosine('q.vec', 'm.vec')}, {PLACES}), 0.0)"
cte("vec_queries", f"""
SELECT v.doc_id, v.pos, v.vec_id, v.vec, c.cluster_id,
       {EPSILON} / count(*) OVER (PARTITION BY v.doc_id) AS eps
FROM vecs v JOIN vec_cells c USING (vec_id)
""")
cte("vec_members", "SELECT label AS cluster_id, vec_id AS key, vec FROM vecs")
draw("vd", "vec_queries", "vec_members", "cluster_id", "doc_id, pos, vec_id", f"q.eps / 2.0 * {SIMILARITY}", DRAW_SEED)

# Text store: embedded survivors, cells by sign, nearest cell.
cte("pub_texts", "SELECT DISTINCT triple FROM pub_survivors")
hash_vectors("pt", "pub_texts", "triple", text="triple")
cte("store", "SELECT md5(triple) AS key, triple AS text, vec::FLOAT[]::DOUBLE[] AS vec FROM pt_vecs")
cte("cells", f"""
SELECT {sign_cell(CELL_BITS)}::INTEGER AS cluster_id, {mean_vec('vec', DIM)} AS centroid FROM store GROUP BY 1
""")
cte("store_cell", nearest("store", "cells", "key"))
cte("store_members", "SELECT s.*, c.cluster_id FROM store s JOIN store_cell c USING (key)")
cte("query_texts", "SELECT * FROM tt_vecs WHERE triple IN (SELECT triple FROM own_survivors)")
cte("query_cell", nearest("query_texts", "cells", "triple"))
cte("text_queries", f"""
SELECT s.doc_id, s.pos, v.vec, c.cluster_id,
       {EPSILON} / count(*) OVER (PARTITION BY s.doc_id) AS eps
FROM own_survivors s JOIN tt_vecs v USING (triple) JOIN query_cell c USING (triple)
""")
draw("td", "text_queries", "store_members", "cluster_id", "doc_id, pos", f"q.eps / 2.0 * {SIMILARITY}", DRAW_SEED)


def verbalize(source: str, name: str) -> None:
    """``(doc_id, text)``: triples in order as sentences."""
    s, r, o = parse_ends("triple")
    cte(f"{name}_text", f"""
    SELECT doc_id, string_agg(concat(concat_ws(' ', {s}, {r}, {o}), '.'), ' ' ORDER BY pos) AS text
    FROM {source} GROUP BY doc_id
    """)


cte("td_chosen", "SELECT d.doc_id, d.pos, s.text AS triple FROM td_drawn d JOIN store s USING (key)")
verbalize("triples", "nodp")
cte("nodp_capped", f"""
SELECT s.doc_id, CASE WHEN len({tokens('s.text')}) > len({tokens('d.text')})
  THEN {detokenize(f"{tokens('s.text')}[1 : len({tokens('d.text')})]")} ELSE s.text END AS text
FROM nodp_text s JOIN docs d USING (doc_id)
""")
verbalize("survivors", "kept")
verbalize("td_chosen", "priv")
cte("released", """
SELECT d.source AS dataset, 'nodp' AS method, 1.0::DOUBLE AS epsilon, d.doc_id, n.text
FROM docs d LEFT JOIN nodp_text n USING (doc_id)
""")
cte("aligned", """
SELECT r.dataset, r.method, r.epsilon, r.doc_id, r.text, d.text AS original
FROM released r JOIN docs d USING (doc_id) WHERE r.text IS NOT NULL
""")
cte("both_texts", "SELECT text FROM aligned UNION SELECT original FROM aligned")
for _kind in ("char3", "char4", "word"):
    hash_vectors(f"m_{_kind}", "both_texts", "text", _kind)
cte("model_cos", " UNION ALL ".join(
    f"""SELECT dataset, method, epsilon, '{k}' AS model, avg({cosine('a.vec', 'b.vec')}) AS cos
    FROM aligned r JOIN m_{k}_vecs a ON a.text = r.original JOIN m_{k}_vecs b ON b.text = r.text
    GROUP BY dataset, method, epsilon"""
    for k in ("char3", "char4", "word")
))
cte("baseline", """
SELECT source AS dataset, 'baseline' AS method, 0.0::DOUBLE AS epsilon, doc_id, text, text AS original FROM docs
""")
cte("both_runs", """
SELECT dataset, method, epsilon, doc_id, text, original FROM aligned
UNION ALL SELECT dataset, method, epsilon, doc_id, text, original FROM baseline
""")
cte("sampled_runs", """
SELECT * EXCLUDE (r) FROM (
  SELECT *, row_number() OVER (PARTITION BY dataset, method, epsilon
    ORDER BY ('0x'||substr(md5('42|'||doc_id),1,13))::BIGINT, doc_id) AS r FROM both_runs)
WHERE r <= 100
""")


def quality(name: str, source: str) -> None:
    ids = "dataset, method, epsilon, doc_id"
    cte(f"{name}_ppl", perplexity("", source, ids))
    cte(f"{name}_parts", f"""
    SELECT {ids}, {words('text')} AS w, length(text) AS len_, length(original) AS olen,
           list_filter(list_transform(regexp_split_to_array(text, '[.!?\\n]+'),
             lambda s: len(regexp_extract_all(s, '[A-Za-z]+'))::DOUBLE), lambda n: n > 0) AS s
    FROM {source}
    """)
    cte(f"{name}_scores", f"""
    SELECT {ids}, unnest([{', '.join(lit(m) for m in METRICS)}]) AS metric, unnest([
      p.ppl,
      CASE WHEN len(s) > 0 THEN list_stddev_pop(s) END,
      CASE WHEN len(w) > 0 THEN list_sum(list_transform(w, lambda x: length(x)))::DOUBLE / len(w) END,
      len_::DOUBLE / nullif(olen, 0),
      CASE WHEN len(w) > 0 THEN 1.0 - len(list_distinct(list_transform(range(1, len(w) + 1),
        lambda i: concat(CASE WHEN i = 1 THEN '<s>' ELSE w[i - 1] END, ' ', w[i]))))::DOUBLE / len(w) END
    ]::DOUBLE[]) AS score
    FROM {name}_parts LEFT JOIN {name}_ppl p USING ({ids})
    """)
    means = ", ".join(
        f"coalesce(round(avg(score) FILTER (metric = '{m}'), 3), 0.0) AS {m}" for m in METRICS
    )
    cte(f"{name}_means", f"SELECT dataset, method, epsilon, {means} FROM {name}_scores GROUP BY ALL")


quality("nodp_q", "aligned")
quality("base_q", "baseline")
quality("runs_q", "sampled_runs")

# Words of conversation turns as draw queries.
_toks = tokens("text")
cte("turn_slots", f"""
SELECT *, coalesce(lower(last_value(CASE WHEN is_word THEN token END IGNORE NULLS) OVER (
         PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), '<s>') AS prev
FROM (SELECT doc_id, (i - 1)::INTEGER AS pos, t[i] AS token, t[i] NOT IN {PUNCT} AS is_word, nw
      FROM (SELECT doc_id, {_toks} AS t, {word_tokens(_toks)} AS nw FROM turns) d, unnest(range(1, len(t) + 1)) r(i))
""")
cte("word_pairs", """
SELECT word, context, sum(n) AS n FROM (
  SELECT prev AS word, word AS context, n FROM counts WHERE prev <> '<s>'
  UNION ALL SELECT word, prev, n FROM counts WHERE prev <> '<s>') GROUP BY word, context
""")
cte("word_sums", "SELECT word, sum(n) AS total FROM word_pairs GROUP BY word")
cte("word_info", """
SELECT word, context, value, ('0x'||substr(md5(context),1,13))::BIGINT AS bits FROM (
  SELECT p.word, p.context, ln(p.n::DOUBLE * (SELECT sum(total) FROM word_sums)::DOUBLE / a.total / b.total) AS value
  FROM word_pairs p JOIN word_sums a ON a.word = p.word JOIN word_sums b ON b.word = p.context) WHERE value > 0
""")
_signs = ", ".join(f"sum(CASE WHEN (bits >> {i}) & 1 = 1 THEN value ELSE -value END)" for i in range(wordvecs.DIM))
cte("word_raw", f"SELECT word, [{_signs}]::DOUBLE[] AS raw FROM word_info GROUP BY word")
cte("word_units", f"""
SELECT word, list_transform({unit('raw')}, lambda x: round(x, {wordvecs.PLACES})) AS vec FROM word_raw
""")
cte("word_cells", f"SELECT word, vec, {sign_cell(wordvecs.CELL_BITS)} AS cell FROM word_units")
cte("word_near", f"""
SELECT word, candidate, sqrt(greatest(2.0 - 2.0 * cos, 0.0)) AS distance FROM (
  SELECT a.word, b.word AS candidate, round(list_inner_product(a.vec, b.vec), {wordvecs.PLACES}) AS cos
  FROM word_cells a JOIN word_cells b USING (cell)) WHERE cos > {1.0 - GAMMA * GAMMA / 2.0!r}
""")
cte("word_counts", "SELECT word, sum(n) AS n FROM counts GROUP BY word")


def redrawn(
    name: str, queries: str, members: str, words_: str, on: str, seed: str, slots: str = "turn_slots", runs: bool = False
) -> None:
    """Words drawn from listed members (``key, u, u0``) and a base (``word, u``) of all words."""
    ids = "doc_id, pos" + ", run" * runs
    qids = ["q.doc_id", "q.pos"] + ["q.run"] * runs
    more = "q.eps / 2.0 * m.u + ln(1.0 - exp(-q.eps / 2.0 * (m.u - m.u0)))"
    draw(name, queries, members, on, "doc_id, pos", more, seed, runs)
    cte(f"{name}_ranked", f"SELECT word, u, row_number() OVER (ORDER BY u, word) - 1 AS rank FROM {words_}")
    cte(f"{name}_classes", f"SELECT u, count(*) AS size, min(rank) AS first FROM {name}_ranked GROUP BY u")
    cte(f"{name}_upto", f"""
    SELECT e.eps, c.*, exp(e.eps / 2.0 * c.u) AS each,
           sum(c.size * exp(e.eps / 2.0 * c.u)) OVER (PARTITION BY e.eps ORDER BY c.u) AS upto
    FROM (SELECT DISTINCT eps FROM {queries}) e, {name}_classes c
    """)
    cte(f"{name}_places", f"""
    SELECT {', '.join(qids)}, q.eps, z, {uniform(seed + '.base', *qids)} * z AS place,
           ln(z) + {gumbel(seed + '.any', *qids)} AS score
    FROM {queries} q JOIN (SELECT eps, max(upto) AS z FROM {name}_upto GROUP BY eps) USING (eps)
    """)
    cte(f"{name}_any", f"""
    SELECT p.* EXCLUDE (eps, z, place), r.word FROM {name}_places p JOIN {name}_upto c
      ON c.eps = p.eps AND p.place >= c.upto - c.size * c.each AND p.place < c.upto
    JOIN {name}_ranked r ON r.rank = c.first + least(floor((p.place - (c.upto - c.size * c.each)) / c.each)::BIGINT, c.size - 1)
    """)
    cte(f"{name}_out", f"""
    SELECT {ids}, CASE WHEN NOT s.is_word THEN s.token WHEN d.score > b.score THEN d.key ELSE b.word END AS token
    FROM {slots} s LEFT JOIN {name}_drawn d USING ({ids}) LEFT JOIN {name}_any b USING ({ids})
    """)


cte("rep_queries", f"SELECT doc_id, pos, lower(token) AS word, {EPSILON} / nw AS eps FROM turn_slots WHERE is_word")
cte("rep_members", f"""
SELECT word, candidate AS key, 1.0 - distance / {GAMMA}::DOUBLE AS u, 0.0::DOUBLE AS u0 FROM word_near WHERE distance < {GAMMA}
""")
cte("rep_words", "SELECT word, 0.0::DOUBLE AS u FROM word_counts")
# For replace_words the neighbours among all words, of the words that are replaced.
cte("all_near", f"""
SELECT word, candidate, sqrt(greatest(2.0 - 2.0 * cos, 0.0)) AS distance FROM (
  SELECT a.word, b.word AS candidate, round(list_inner_product(a.vec, b.vec), {wordvecs.PLACES}) AS cos
  FROM (SELECT DISTINCT word FROM rep_queries) JOIN word_units a USING (word) CROSS JOIN word_units b)
WHERE cos > {1.0 - GAMMA * GAMMA / 2.0!r}
""")
cte("all_members", f"""
SELECT word, candidate AS key, 1.0 - distance / {GAMMA}::DOUBLE AS u, 0.0::DOUBLE AS u0 FROM all_near WHERE distance < {GAMMA}
""")
redrawn("rd", "rep_queries", "all_members", "rep_words", "word", DRAW_SEED)


# The sweep: words of turns by role, triples of documents by source, each over its grid.
def run_grid(name: str, source: str, dataset: str) -> None:
    cte(name, f"""
    SELECT dataset, epsilon, printf('%.4f', epsilon) AS run FROM (
      SELECT {dataset} AS dataset, round(floor(avg({word_tokens(tokens('text'))})) * f, 4) AS epsilon
      FROM {source}, (VALUES {', '.join(f'({f}::DOUBLE)' for f in FACTORS)}) x(f) GROUP BY {dataset}, f)
    """)


def run_id(dataset: str, doc_id: str) -> str:
    return f"concat(length({dataset}), ':', {dataset}, '/', {doc_id})"


run_grid("role_grid", "turns", "role")
run_grid("source_grid", "docs", "source")
cte("run_slots", f"""
SELECT {run_id('t.role', 'doc_id')} AS doc_id, pos, token, is_word, g.run, g.epsilon / nw AS eps, t.role, g.epsilon, t.doc_id AS of_doc
FROM turn_slots s JOIN turns t USING (doc_id) JOIN role_grid g ON g.dataset = t.role
""")
cte("run_queries", "SELECT doc_id, pos, run, lower(token) AS word, eps FROM run_slots WHERE is_word")
redrawn("rr", "run_queries", "rep_members", "rep_words", "word", DRAW_SEED, "run_slots", True)
cte("triple_run_queries", f"""
SELECT {run_id('d.source', 'q.doc_id')} AS doc_id, q.pos, q.vec, q.cluster_id, g.run,
       g.epsilon / count(*) OVER (PARTITION BY q.doc_id, g.run) AS eps
FROM text_queries q JOIN docs d USING (doc_id) JOIN source_grid g ON g.dataset = d.source
""")
draw("tr", "triple_run_queries", "store_members", "cluster_id", "doc_id, pos", f"q.eps / 2.0 * {SIMILARITY}", DRAW_SEED, True)
cte("run_chosen", "SELECT d.doc_id, d.run, d.pos, s.text AS triple FROM tr_drawn d JOIN store s USING (key)")
_ends = parse_ends("triple")
cte("run_texts", f"""
SELECT doc_id, run, string_agg(concat(concat_ws(' ', {_ends[0]}, {_ends[1]}, {_ends[2]}), '.'), ' ' ORDER BY pos) AS text
FROM run_chosen GROUP BY doc_id, run
""")


def logit_utility(probability: str) -> str:
    return f"round(({clamp(f'ln({probability})', LM_LOW, LM_HIGH)} - ({LM_LOW})) / {LM_HIGH - LM_LOW}, 12)"


_single = "(0.2::DOUBLE * w.n::DOUBLE / (SELECT sum(n) FROM word_counts)::DOUBLE)"
cte("mlm_queries", "SELECT doc_id, pos, prev, 50.0::DOUBLE / nw AS eps FROM turn_slots WHERE is_word")
cte("mlm_members", f"""
SELECT prev, word AS key, {logit_utility(f"0.8::DOUBLE * l.n / l.n_prev + {_single}")} AS u, {logit_utility(_single)} AS u0
FROM lm l JOIN word_counts w USING (word)
WHERE {logit_utility(f"0.8::DOUBLE * l.n / l.n_prev + {_single}")} > {logit_utility(_single)}
""")
cte("mlm_words", f"SELECT word, {logit_utility(_single)} AS u FROM word_counts w")
redrawn("md", "mlm_queries", "mlm_members", "mlm_words", "prev", DRAW_SEED)

cte("logits", "SELECT doc_id, pos, (i - 1)::INTEGER AS token, vec[i] * 60.0 AS logit FROM vecs, unnest(range(1, 65)) r(i)")
cte("utilities", f"""
SELECT v.label, v.vec_id, greatest({cosine('v.vec', 'c.centroid')}, 0.0) AS utility
FROM vecs v JOIN label_means c ON c.cluster_id = v.label
""")
cte("grid", f"""
SELECT source AS dataset, round(floor(avg({word_tokens(tokens('text'))})) * f, 4) AS epsilon
FROM docs, (VALUES {', '.join(f'({f}::DOUBLE)' for f in FACTORS)}) x(f) GROUP BY source, f
""")
cte("signed_vecs", f"SELECT *, {sign_cell(4)} AS cell FROM vecs")
cte("km0", f"SELECT cell AS cluster_id, {mean_vec('vec', 64)} AS centroid FROM signed_vecs GROUP BY cell")
for _r in range(3):
    cte(f"km_near{_r}", nearest("vecs", f"km{_r}", "vec_id", "euclidean"))
    cte(f"km{_r + 1}", f"""
    SELECT k.cluster_id, coalesce(m.centroid, k.centroid) AS centroid FROM km{_r} k LEFT JOIN (
      SELECT n.cluster_id, {mean_vec('v.vec', 64)} AS centroid
      FROM km_near{_r} n JOIN vecs v USING (vec_id) GROUP BY n.cluster_id) m USING (cluster_id)
    """)


def kmeans(name: str, k: int, passes: int) -> None:
    """Lloyd passes from every n/k-th vector in the order of signs; the last table is ``<name><passes>``."""
    cte(f"{name}0", f"""
    SELECT i::INTEGER AS cluster_id, vec AS centroid
    FROM vec_order JOIN range({k}) r(i) ON position = (i * n) // least({k}, n) WHERE i < n
    """)
    for r in range(passes):
        cte(f"{name}_near{r}", nearest("vecs", f"{name}{r}", "vec_id", "euclidean"))
        cte(f"{name}{r + 1}", f"""
        SELECT k.cluster_id, coalesce(m.centroid, k.centroid) AS centroid FROM {name}{r} k LEFT JOIN (
          SELECT n.cluster_id, {mean_vec('v.vec', 64)} AS centroid
          FROM {name}_near{r} n JOIN vecs v USING (vec_id) GROUP BY n.cluster_id) m USING (cluster_id)
        """)


cte("vec_order", """
SELECT vec_id, vec, count(*) OVER () AS n, row_number() OVER (ORDER BY array_to_string(
         list_transform(vec, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), ''), vec_id) - 1 AS position
FROM vecs
""")
kmeans("kf", KMEANS[0], KMEANS[1])
for _mode, (_k, _passes) in SIZES.items():
    _g = f"g{_mode}_"
    kmeans(_g, _k, _passes)
    cte(f"{_g}label", nearest("vecs", f"{_g}{_passes}", "vec_id", "euclidean"))
    cte(f"{_g}members", f"SELECT cluster_id, md5(vec_id::VARCHAR) AS key, vec, vec_id FROM vecs JOIN {_g}label USING (vec_id)")
    cte(f"{_g}cell", nearest("vecs", f"{_g}{_passes}", "vec_id"))
    cte(f"{_g}queries", f"""
    SELECT v.doc_id, v.pos, v.vec, c.cluster_id, {EPSILON} / count(*) OVER (PARTITION BY v.doc_id) AS eps
    FROM vecs v JOIN {_g}cell c USING (vec_id)
    """)
    draw(f"{_g}", f"{_g}queries", f"{_g}members", "cluster_id", "doc_id, pos", f"q.eps / 2.0 * {SIMILARITY}", DRAW_SEED)
for _bits in (2, 3, 4):
    cte(f"wb{_bits}", f"""
    SELECT {sign_cell(_bits)} AS cluster_id, {mean_vec('vec', 64)} AS centroid FROM vecs GROUP BY 1
    """)
    cte(f"wb_near{_bits}", nearest("vecs", f"wb{_bits}", "vec_id"))


# ---- composition --------------------------------------------------------------------------


def compose(sql: str) -> str:
    """Prefix the shared tables that ``sql`` needs, directly or not, in dependency order."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in sorted(set(re.findall(r"[a-z][a-z_0-9]*", text)) & CTES.keys()):
            if name not in order:
                visit(re.sub(rf"\b{name}\b", "", CTES[name]))
                order.append(name)

    visit(sql)
    if not order:
        return sql
    tables = ",\n".join(f"{n} AS MATERIALIZED ({CTES[n]})" for n in order)
    return f"WITH {tables}\n{sql}"


def components(source: str, ids: str, vec: str, dim: int, value: str = "x") -> str:
    """One row per vector component; ``value`` may use x and the index i."""
    return f"""
    SELECT {ids}, i::INTEGER AS i, round({value}, 6) AS x
    FROM (SELECT {ids}, i - 1 AS i, {vec}[i] AS x FROM {source}, unnest(range(1, {dim + 1})) r(i))
    """


def _noisy(draw_sql: str, base: str = "x") -> str:
    return components("vecs", "vec_id, doc_id, pos", "vec", 64, f"{base} + {draw_sql}")


def _scale(method: str, width: float | None = None) -> str:
    return repr(noise.noise_scale(57.5, 64, method, width=width))


def _drop_ids(sql: str) -> str:
    return f"SELECT vec_id, i, x FROM ({sql})"


_labels = " ".join(
    f"WHEN {i} THEN {noise.noise_scale(e, 64, 'analytic_gaussian')!r}" for i, e in enumerate(NOISE_EPSILONS)
)
_clip = f"least(greatest(x, {noise.CLIP_LOW}::DOUBLE), {noise.CLIP_HIGH}::DOUBLE)"
_prompt = f"{lit(tx.PARAPHRASE_PREFIX)} || text || {lit(tx.PARAPHRASE_SUFFIX)}".replace("\n", "'||chr(10)||'")
_s, _r_, _o = parse_ends("triple")
_turns = [("system", lit(DEFAULT_SYSTEM))]
for _question, _answer in DEFAULT_EXAMPLES:
    _turns += [("user", lit(_question)), ("assistant", lit(_answer))]
_policy_text = "CASE p WHEN 'passthrough' THEN coalesce(n.text, d.text) ELSE n.text END"
_mlm_temperature = f"2.0 * {abs(MAX_LOGIT - MIN_LOGIT)!r}"
_clean = "'Sure.'||chr(10)||'Output text: '||text||chr(10)||CASE WHEN turn % 2 = 0 THEN 'Note: done' ELSE 'USER: more' END"


def _before(text: str, marker: str) -> str:
    return f"string_split({text}, {lit(marker)})[1]"


_cleaned = f"trim(list_last(string_split({_clean}, {lit(tx.ANSWER_MARKER)})), chr(32)||chr(9)||chr(13)||chr(10))"
_cleaned = f"replace({_cleaned}, chr(10), '')"
for _m in tx.CUT_MARKERS:
    _cleaned = _before(_cleaned, _m)
_cleaned = f"trim({_cleaned}, chr(32)||chr(9)||chr(13)||chr(10))"

_SQL = {
    "dataset_projection": """
        SELECT 'documents' AS dataset, doc_id, text FROM documents
        UNION ALL SELECT 'pages', page_id, html FROM pages
        UNION ALL SELECT 'benchmark', item_id, text FROM benchmark""",
    "dataset_csv": """
        SELECT 'documents' AS dataset, (('0x'||substr(md5(content||'/'||row_number() OVER (PARTITION BY content)),1,16))::UBIGINT >> 1)::BIGINT AS doc_id,
               lang, length(text)::INTEGER AS n_chars
        FROM (SELECT *, md5(coalesce(length(text)||':'||text, '-')||coalesce(length(lang)||':'||lang, '-')) AS content FROM documents)""",
    "store_join": f"""
        SELECT v.vec_id, count(*) AS n, round(max({cosine('v.vec', 'o.vec')}), 6) AS best
        FROM vecs v JOIN vec_cells c USING (vec_id) JOIN vecs o ON o.label = c.cluster_id GROUP BY v.vec_id""",
    "stream_ingest": "SELECT DISTINCT md5(triple) AS key, triple AS text FROM survivors JOIN accepted USING (doc_id)",
    "ingest_stats": """
        SELECT (SELECT count(*) FROM accepted) AS documents, (SELECT count(DISTINCT triple) FROM accepted_triples) AS triples""",
    "triple_store_upsert": """
        SELECT md5(triple) AS key, triple AS text
        FROM (SELECT triple FROM triples UNION SELECT triple FROM item_triples)""",
    "label_writeback": """
        SELECT md5(vec_id::VARCHAR) AS key, vec_id, a.cluster_id AS fiftyk, b.cluster_id AS hundredk,
               c.cluster_id AS twohundredk
        FROM wb_near2 a JOIN wb_near3 b USING (vec_id) JOIN wb_near4 c USING (vec_id)""",
    "release_roundtrip": """
        SELECT r.dataset, r.method, r.epsilon, r.doc_id, r.text, d.lang FROM released r JOIN docs d USING (doc_id)""",
    "release_discovery": "SELECT dataset, method, epsilon, count(*) AS n FROM released GROUP BY ALL",
    "corpus_filter": "SELECT doc_id, text FROM accepted",
    "corpus_cap": "SELECT doc_id FROM accepted ORDER BY doc_id LIMIT 400",
    "truncate_tokens": f"SELECT doc_id, array_to_string({tokens('text')}[1:512], ' ') AS head FROM documents",
    "no_triple_policy": f"""
        SELECT p AS policy, d.doc_id, {_policy_text} AS text
        FROM docs d LEFT JOIN nodp_text n USING (doc_id), (VALUES ('null'), ('passthrough'), ('drop')) x(p)
        WHERE p <> 'drop' OR n.text IS NOT NULL""",
    "tokenize": f"""
        SELECT doc_id, (i - 1)::INTEGER AS pos, t[i] AS token, t[i] IN {PUNCT} AS punct
        FROM (SELECT doc_id, {tokens('text')} AS t FROM turns) d, unnest(range(1, len(t) + 1)) r(i)""",
    "detokenize": f"SELECT doc_id, {detokenize(tokens('text'))} AS text FROM documents",
    "extract_triples": "SELECT doc_id, pos, subject, relation, object, triple FROM raw",
    "triple_render": "SELECT triple, count(*) AS n FROM raw GROUP BY triple",
    "triple_dedupe": "SELECT doc_id, triple, min(pos) AS pos FROM raw GROUP BY doc_id, triple",
    "triple_parse": f"""
        SELECT doc_id, pos, {_o} AS subject, {_r_} AS relation, {_s} AS object FROM triples""",
    "shingles": "SELECT doc_id, pos, shingle FROM grams",
    "minhash_signature": """
        SELECT doc_id, pos, string_agg(m::VARCHAR, ',' ORDER BY i) AS sig FROM mins GROUP BY doc_id, pos""",
    "lsh_index": f"""
        SELECT doc_id, band * {SPAN} + members[1] AS bucket, len(members) AS n, unnest(members) AS pos FROM bucket_sets""",
    "triple_degree": "SELECT doc_id, pos, degree FROM degrees",
    "star_clusters": "SELECT doc_id, seed, member FROM clusters",
    "triple_ppl": "SELECT doc_id, pos, n_words, round(ppl, 6) AS ppl FROM covered_ppl",
    "cluster_best": "SELECT doc_id, seed, pos FROM best",
    "surviving_triples": "SELECT doc_id, pos, triple FROM survivors",
    "ngram_counts": "SELECT prev, word, n FROM counts",
    "ngram_lm_probabilities": "SELECT prev, word, n, n_prev, round(exp(logp / 1e9), 6) AS p FROM lm",
    "perplexity": f"SELECT doc_id, n_words, round(ppl, 4) AS ppl FROM ({perplexity('', 'docs', 'doc_id')})",
    "perplexity_mean": f"SELECT round(avg(ppl), 4) AS mean_ppl FROM ({perplexity('', 'docs', 'doc_id')})",
    "embed_triples": components("tt_vecs", "triple", "vec", DIM),
    "truncate_dim": components("vecs32", "vec_id", "vec", DIM),
    "kmeans_fit": components(f"kf{KMEANS[1]}", "cluster_id", "centroid", 64),
    "granularity_roundtrip": " UNION ALL ".join(f"""
        SELECT '{m}' AS granularity, d.doc_id, d.pos, s.vec_id AS chosen_id, s.cluster_id,
               (SELECT count(*) FROM g{m}_label l WHERE l.cluster_id = s.cluster_id) AS n
        FROM g{m}__drawn d JOIN g{m}_members s USING (key)""" for m in SIZES),
    "kmeans_refine": components("km3", "cluster_id", "centroid", 64),
    "kmeans_assign": nearest("vecs", "label_means", "vec_id", "euclidean"),
    "cluster_counts": f"""
        SELECT id::INTEGER AS cluster_id, count(vec_id) AS n FROM range(12) r(id)
        LEFT JOIN ({nearest('vecs', 'label_means', 'vec_id')}) c ON c.cluster_id = id GROUP BY id""",
    "nearest_centroid": "SELECT vec_id, cluster_id FROM vec_cells",
    "cluster_candidates": f"""
        SELECT q.vec_id, count(*) AS n_candidates, round(max({SIMILARITY}), 6) AS max_utility,
               round(avg({SIMILARITY}), 6) AS mean_utility
        FROM vec_queries q JOIN vec_members m USING (cluster_id) GROUP BY q.vec_id""",
    "cluster_topk": f"""
        SELECT vec_id, rank::INTEGER AS rank, neighbour, round(u, 6) AS utility FROM (
          SELECT q.vec_id, m.key AS neighbour, {SIMILARITY} AS u,
                 row_number() OVER (PARTITION BY q.vec_id ORDER BY {SIMILARITY} DESC, m.key) AS rank
          FROM vec_queries q JOIN vec_members m USING (cluster_id)) WHERE rank <= 5""",
    "pairwise_cosine": f"""
        SELECT v.vec_id, round({cosine('v.vec', 'c.centroid')}, 6) AS cos
        FROM vecs v JOIN label_means c ON c.cluster_id = v.label""",
    "budget_split": f"""
        SELECT doc_id, pos, round({EPSILON} / count(*) OVER (PARTITION BY doc_id), 6) AS eps FROM triples""",
    "exponential_mechanism": f"""
        SELECT label, run::INTEGER AS run,
               arg_max(vec_id, {EPSILON} * utility / 2.0 + {gumbel(DRAW_SEED, 'label', 'run', 'vec_id')}) AS chosen
        FROM utilities, range(10) r(run) GROUP BY label, run""",
    "exponential_probs": f"""
        SELECT label, vec_id, round(exp({EPSILON} * utility / 2.0)
               / sum(exp({EPSILON} * utility / 2.0)) OVER (PARTITION BY label), 6) AS prob FROM utilities""",
    "privatize_triples": "SELECT doc_id, pos, vec_id, key AS chosen_id FROM vd_drawn",
    "privatize_triples_hot": "SELECT doc_id, pos, vec_id, key AS chosen_id FROM vd_drawn",
    "vector_clip": components("vecs", "vec_id", "vec", 64, _clip),
    "noise_laplace": _drop_ids(_noisy(laplace(_scale("laplace"), DRAW_SEED, "doc_id", "pos", "i"))),
    "noise_gaussian": _drop_ids(_noisy(normal(_scale("gaussian"), DRAW_SEED, "doc_id", "pos", "i"))),
    "noise_shared": _drop_ids(_noisy(normal(_scale("gaussian"), DRAW_SEED, "doc_id", "i"))),
    "noise_analytic": _drop_ids(components(
        "vecs", "vec_id, doc_id, pos, label", "vec", 64,
        "x + " + normal(f"CASE label % 3 {_labels} END", DRAW_SEED, "doc_id", "pos", "i"))),
    "privatize_vectors": _drop_ids(_noisy(
        laplace(_scale("laplace", noise.CLIP_HIGH - noise.CLIP_LOW), DRAW_SEED, "doc_id", "pos", "i"), _clip)),
    "logit_clip": f"SELECT doc_id, pos, token, round({clamp('logit')}, 6) AS logit FROM logits",
    "token_budget": f"SELECT doc_id, round(100.0::DOUBLE / nullif(len({tokens(_prompt)}), 0), 6) AS eps FROM documents",
    "word_budget": f"SELECT doc_id, round(100.0::DOUBLE / nullif({word_tokens(tokens('text'))}, 0), 6) AS eps FROM documents",
    "budget_temperature": f"""
        SELECT doc_id, round({_mlm_temperature} / (57.5::DOUBLE / len({tokens(_prompt)})), 6) AS temperature
        FROM documents""",
    "sample_tokens": f"""
        SELECT doc_id, pos, arg_max(token, {clamp('logit')} / ({_mlm_temperature} / (575.0::DOUBLE / n))
               + {gumbel(DRAW_SEED, 'doc_id', 'pos', 'token')}) AS token
        FROM logits JOIN (SELECT doc_id, count(DISTINCT pos) AS n FROM logits GROUP BY doc_id) USING (doc_id)
        GROUP BY doc_id, pos""",
    "sample_tokens_direct": f"""
        SELECT doc_id, pos, arg_max(token, {clamp('logit')} / ({_mlm_temperature} / 100.0::DOUBLE)
               + {gumbel(DRAW_SEED, 'doc_id', 'pos', 'token')}) AS token FROM logits GROUP BY doc_id, pos""",
    "word_neighbours": "SELECT word, candidate, round(distance, 6) AS distance FROM word_near",
    "replace_words": "SELECT doc_id, pos, token FROM rd_out",
    "rewrite_tokens": "SELECT doc_id, pos, token FROM md_out",
    "rewrite_text": f"""
        SELECT doc_id, {detokenize('list(token ORDER BY pos)')} AS text FROM md_out GROUP BY doc_id""",
    "epsilon_grid": "SELECT dataset, epsilon FROM grid",
    "sweep": f"""
        SELECT g.dataset, 'words' AS method, g.epsilon, d.doc_id, md5(array_to_string({words('d.text')}, ' ')) AS digest
        FROM docs d JOIN grid g ON g.dataset = d.source""",
    "sweep_mechanisms": f"""
        SELECT role AS dataset, 'words' AS method, epsilon, of_doc AS doc_id, md5({detokenize('toks')}) AS digest
        FROM (SELECT s.role, s.epsilon, s.of_doc, list(o.token ORDER BY s.pos) AS toks
              FROM run_slots s JOIN rr_out o USING (doc_id, pos, run) GROUP BY ALL)
        UNION ALL
        SELECT g.dataset, 'triples', g.epsilon, d.doc_id, md5(t.text)
        FROM docs d JOIN source_grid g ON g.dataset = d.source
        LEFT JOIN run_texts t ON t.doc_id = {run_id('d.source', 'd.doc_id')} AND t.run = g.run""",
    "resume_grid": """
        SELECT dataset, epsilon FROM grid
        WHERE epsilon > (SELECT min(o.epsilon) FROM grid o WHERE o.dataset = grid.dataset)""",
    "assemble_prompts": " UNION ALL ".join(
        f"SELECT DISTINCT doc_id, {i} AS turn, '{role}' AS role, {content} AS content FROM triples"
        for i, (role, content) in enumerate(_turns)
    ) + f"""
        UNION ALL SELECT doc_id, {len(_turns)}, 'user', concat('Input triples: [', string_agg(concat(
          chr(123)||'subject: ', {_s}, ', relation: ', {_r_}, ', object: ', {_o}, chr(125)), ', ' ORDER BY pos), ']')
        FROM triples GROUP BY doc_id""",
    "paraphrase_prompt": f"SELECT doc_id, {_prompt} AS prompt FROM documents",
    "reconstruct_text": "SELECT doc_id, text FROM nodp_capped",
    "reconstruct_nodp": "SELECT doc_id, k.text FROM docs LEFT JOIN kept_text k USING (doc_id)",
    "clean_generation": f"SELECT conv_id, turn, {_cleaned} AS text FROM conversations",
    "privatize_documents": "SELECT doc_id, p.text FROM docs LEFT JOIN priv_text p USING (doc_id)",
    "eval_align": """
        SELECT dataset, doc_id, length(text)::INTEGER AS n_private, length(original)::INTEGER AS n_original FROM aligned""",
    "cosine_by_model": "SELECT dataset, method, epsilon, model, round(cos, 6) AS cos FROM model_cos",
    "cosine_summary": """
        SELECT dataset, method, epsilon, round(avg(cos), 3) AS cs,
               string_agg(printf('%.4f', cos), ',' ORDER BY model) AS scores FROM model_cos GROUP BY ALL""",
    "eval_sample": """
        SELECT dataset, doc_id FROM (
          SELECT dataset, doc_id, row_number() OVER (PARTITION BY dataset
            ORDER BY ('0x'||substr(md5('42|'||doc_id),1,13))::BIGINT, doc_id) AS r
          FROM aligned) WHERE r <= 20""",
    "text_quality": "SELECT dataset, doc_id, metric, round(score, 4) AS score FROM nodp_q_scores",
    "judge_means": "SELECT * FROM nodp_q_means",
    "score_log": """
        SELECT dataset, method, epsilon, 'cosine' AS log, round(avg(cos), 3) AS cs, NULL::DOUBLE AS bigram_ppl,
               NULL::DOUBLE AS sent_len_stddev, NULL::DOUBLE AS mean_word_len, NULL::DOUBLE AS length_ratio,
               NULL::DOUBLE AS repeated_bigram_ratio
        FROM model_cos GROUP BY ALL
        UNION ALL
        SELECT dataset, method, epsilon, 'judge', NULL, bigram_ppl, sent_len_stddev, mean_word_len, length_ratio,
               repeated_bigram_ratio
        FROM nodp_q_means""",
    "eval_baseline": "SELECT * FROM base_q_means",
    "eval_private": "SELECT * FROM runs_q_means",
}
ORACLES = {name: compose(sql.strip()) for name, sql in _SQL.items()}
