"""Named queries over the driver's tables, each with the SQL that gives the same rows.

No table holds sequences, so pairs are made from order keys, alike in both engines: a is spelt from a digest of the key;
b is a with up to two edits, or, for every fifth key, unrelated. Some sides are empty, shorter than a seed, or longer than
64 letters; customers give pairs of up to 515 letters.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqloom.functions import align as A
from seqloom.functions import cigar, cost_model, expr
from seqloom.operators import heuristics as H
from seqloom.operators import seeds as S
from seqloom.operators import similarity
from seqloom.operators.search import search_blocks
from seqloom.plans import reports
from seqloom.plans.aligner import PRESETS, aligner
from seqloom.sources import datasource
from seqloom.sources.generate import pairs_of
from seqloom.sources.pairs import read_pairs, simulated_pairs, write_costs, write_seq
from seqloom.sources.scratch import shared_dir

Query = Callable[[SparkSession, str], DataFrame]
K, K2, BOUND = 4, 5, 8

_DNA = "translate(md5({}), '0123456789abcdef', 'ACGTACGTACGTACGT')"
_KEY = "cast(o_orderkey as {string})"
PAIRS = f"""
SELECT id, CASE kind WHEN 0 THEN '' WHEN 2 THEN '' WHEN 4 THEN concat(a, more, 'C') ELSE a END AS a,
  CASE kind WHEN 1 THEN '' WHEN 2 THEN '' WHEN 3 THEN substring(b, 1, 3) WHEN 4 THEN concat(b, substring(more, 1, 20), 'G', substring(more, 22)) ELSE b END AS b
FROM (
  SELECT cast(o_orderkey as bigint) AS id, a, o_orderkey % 50 AS kind, {_DNA.format("concat('more', " + _KEY + ")")} AS more,
    CASE WHEN o_orderkey % 5 = 0 THEN {_DNA.format("concat('other', " + _KEY + ")")}
         ELSE concat(substring(a, 1, cast(o_orderkey % 20 as int) + 1),
                     CASE o_orderkey % 3 WHEN 0 THEN 'G' WHEN 1 THEN '' ELSE 'TT' END,
                     substring(a, cast(o_orderkey % 20 as int) + 3)) END AS b
  FROM (SELECT o_orderkey, {_DNA.format(_KEY)} AS a FROM orders) o) p
"""
PAIRS_SQL = PAIRS.replace("{string}", "varchar")


def dealt(keys: DataFrame, by: str) -> DataFrame:
    """keys in as many parts as shuffles make, and none merged with others because it is small: a file of keys has few row
    groups, and the pairs made from a few bytes take much work."""
    return keys.repartition(int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")), by)


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, a, b) of every order."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey")
    return _pairs_of(orders)


def _pairs_of(orders: DataFrame) -> DataFrame:
    return orders.sparkSession.sql(PAIRS.replace("{string}", "string").replace("FROM orders", "FROM {orders}"), orders=orders)


_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _dealt_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs_of(dealt(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey"), "o_orderkey"))


def query(name: str, sql: str | None = None, with_pairs: bool = True, heavy: bool = False) -> Callable[[Callable], Callable]:
    """Registers a query; sql may use the view p (id, a, b). heavy: its pairs take much work each, so they are dealt to all
    tasks, not only to those that read the keys."""

    def add(f: Callable) -> Callable:
        _QUERIES[name] = (lambda spark, sf_dir: f((_dealt_pairs if heavy else pairs)(spark, sf_dir))) if with_pairs else f
        if sql is not None:
            if with_pairs:
                head = f"p AS ({PAIRS_SQL})"
                body = sql.strip()
                _SQL[name] = f"WITH RECURSIVE {head}, {body[15:]}" if body.startswith("WITH RECURSIVE ") else f"WITH {head}, {body[5:]}" if body.startswith("WITH ") else f"WITH {head} {body}"
            else:
                _SQL[name] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# --- distances and bounds --------------------------------------------------------------------------------------------


@query("unit_distance", "SELECT id, levenshtein(a, b)::INT AS cost FROM p")
def unit_distance(p: DataFrame) -> DataFrame:
    return p.select("id", expr.distance("a", "b").alias("cost"))


@query("bounded_distance", f"SELECT id, (CASE WHEN levenshtein(a, b) <= {BOUND} THEN levenshtein(a, b) END)::INT AS cost FROM p")
def bounded_distance(p: DataFrame) -> DataFrame:
    return p.select("id", expr.bounded_distance("a", "b", BOUND).alias("cost"))


@query("gap_bound", "SELECT id, abs(length(a) - length(b))::INT AS bound FROM p")
def gap_bound(p: DataFrame) -> DataFrame:
    return p.select("id", expr.gap_bound("a", "b").alias("bound"))


def _count_sql(letters: str) -> str:
    of = lambda x, c: f"(length({x}) - length(replace({x}, '{c}', '')))"
    over = " + ".join(f"greatest({of('a', c)} - {of('b', c)}, 0)" for c in letters)
    under = " + ".join(f"greatest({of('b', c)} - {of('a', c)}, 0)" for c in letters)
    return f"greatest({over}, {under})"


@query("count_bound", f"SELECT id, {_count_sql('ACGT')}::INT AS bound FROM p")
def count_bound(p: DataFrame) -> DataFrame:
    return p.select("id", expr.count_bound("a", "b").alias("bound"))


def _pair_count_sql() -> str:
    of = lambda x, w: f"len([1 FOR i IN range(1, length({x})) IF substring({x}, i::INT, 2) = '{w}'])"
    words = [c + d for c in "ACGT" for d in "ACGT"]
    over = " + ".join(f"greatest({of('a', w)} - {of('b', w)}, 0)" for w in words)
    under = " + ".join(f"greatest({of('b', w)} - {of('a', w)}, 0)" for w in words)
    return f"greatest({_count_sql('ACGT')}, ceil(greatest({over}, {under}) / 2.0))"


@query("pair_count_bound", f"SELECT id, {_pair_count_sql()}::INT AS bound FROM p")
def pair_count_bound(p: DataFrame) -> DataFrame:
    return p.select("id", expr.pair_count_bound("a", "b").alias("bound"))


@query("bounds_and_distance", f"SELECT id, abs(length(a) - length(b))::INT AS gap, {_count_sql('ACGT')}::INT AS letters, {_pair_count_sql()}::INT AS pairs, greatest(length(a), length(b))::INT AS most, levenshtein(a, b)::INT AS cost, 0::INT AS zero FROM p")
def bounds_and_distance(p: DataFrame) -> DataFrame:
    bounds = {"gap": expr.gap_bound("a", "b"), "letters": expr.count_bound("a", "b"), "pairs": expr.pair_count_bound("a", "b"), "zero": expr.zero_bound("a", "b")}
    return p.select("id", *[c.alias(n) for n, c in bounds.items()], expr.max_length("a", "b").alias("most"), expr.distance("a", "b").alias("cost"))


@query("best_bound", f"SELECT id, greatest(abs(length(a) - length(b)), {_count_sql('ACGT')}, {_pair_count_sql()})::INT AS bound FROM p")
def best_bound(p: DataFrame) -> DataFrame:
    return p.select("id", expr.best_bound(expr.gap_bound("a", "b"), expr.count_bound("a", "b"), expr.pair_count_bound("a", "b")).alias("bound"))


@query("suffix_distance", "SELECT id, levenshtein(substring(a, 9), substring(b, 8))::INT AS cost FROM p")
def suffix_distance(p: DataFrame) -> DataFrame:
    return p.select("id", expr.suffix_distance("a", "b", F.lit(8), F.lit(7)).alias("cost"))


@query("common_prefix", "SELECT id, coalesce((SELECT min(i) - 1 FROM range(1, least(length(a), length(b)) + 1) t(i) WHERE a[i] <> b[i]), least(length(a), length(b)))::INT AS n FROM p")
def common_prefix(p: DataFrame) -> DataFrame:
    return p.select("id", expr.common_prefix("a", "b").alias("n"))


@query("near_pairs", f"SELECT id, levenshtein(a, b)::INT AS cost FROM p WHERE levenshtein(a, b) <= {BOUND}")
def near_pairs(p: DataFrame) -> DataFrame:
    return similarity.near_pairs(p, BOUND).select("id", "cost")


@query("similar_names", "WITH n AS (SELECT DISTINCT p_name AS t FROM part) SELECT x.t AS text_a, y.t AS text_b, levenshtein(x.t, y.t)::INT AS cost FROM n x, n y WHERE levenshtein(x.t, y.t) <= 3", with_pairs=False)
def similar_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_name").alias("text"))
    return similarity.near_texts(names, names, 3)


@query(
    "similar_benchmark",
    "WITH n AS (SELECT DISTINCT text AS t FROM benchmark) SELECT x.t AS text_a, y.t AS text_b, levenshtein(x.t, y.t)::INT AS cost FROM n x, n y WHERE levenshtein(x.t, y.t) <= 12",
    with_pairs=False,
)
def similar_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text")
    return similarity.near_texts(texts, texts, 12)


@query("byte_distance", "SELECT x.item_id AS id, levenshtein(x.text, y.text)::INT AS cost FROM benchmark x JOIN benchmark y ON y.item_id = x.item_id + 1", with_pairs=False)
def byte_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("id"), F.col("text").alias("a"))
    y = x.select((F.col("id") - 1).alias("id"), F.col("a").alias("b"))
    return x.join(y, "id").select("id", expr.distance("a", "b").alias("cost"))


# --- seeds and matches -----------------------------------------------------------------------------------------------

_SEEDS = f"s AS (SELECT id, (t * {K})::INT AS start, substring(a, (t * {K} + 1)::INT, {K}) AS q FROM (SELECT id, a, unnest(range(0, length(a) // {K})) AS t FROM p))"
_KMERS = f"k AS (SELECT id, j::INT AS j, substring(b, (j + 1)::INT, {K}) AS q FROM (SELECT id, b, unnest(range(0, length(b) - {K} + 1)) AS j FROM p))"
_MATCHES = f'm AS (SELECT s.id, s.start AS start_i, k.j AS start_j, s.start + {K} AS end_i, k.j + {K} AS end_j FROM s JOIN k ON s.id = k.id AND s.q = k.q)'


@query("seeds", f"WITH {_SEEDS} SELECT id, start, start + {K} AS \"end\", 1::INT AS seed_potential, 1::INT AS seed_cost, q FROM s")
def seeds(p: DataFrame) -> DataFrame:
    return S.seeds(p, K)


@query("kmers", f"WITH {_KMERS} SELECT id, j, q FROM k")
def kmers(p: DataFrame) -> DataFrame:
    return S.kmers(p, K)


@query("kmer_codes", f"WITH {_KMERS} SELECT id, j, ({" + ".join(f"((ascii(q[{c + 1}]) >> 1) & 3) * {4 ** (K - 1 - c)}" for c in range(K))})::BIGINT AS code FROM k")
def kmer_codes(p: DataFrame) -> DataFrame:
    return S.kmers(p, K).select("id", "j", expr.kmer_code("q").alias("code"))


@query("matches_exact", f"WITH {_SEEDS}, {_KMERS}, {_MATCHES} SELECT *, 0::INT AS match_cost, 1::INT AS seed_potential FROM m")
def matches_exact(p: DataFrame) -> DataFrame:
    return S.matches_exact(p, K)


@query("matches_per_pair", f"WITH {_SEEDS}, {_KMERS}, {_MATCHES} SELECT id, count(*) AS n FROM m GROUP BY id")
def matches_per_pair(p: DataFrame) -> DataFrame:
    return S.matches_exact(p, K).groupBy("id").agg(F.count("*").alias("n"))


def _p_sql(i: str, n: str = "length(a)", k: int = K, r: int = 1) -> str:
    return f"({r} * greatest(0, {n} // {k} - (({i}) + {k - 1}) // {k}))"


@query("seed_potential", f"SELECT id, i::INT AS i, {_p_sql('i')}::INT AS potential, (CASE WHEN i // {K} < length(a) // {K} THEN (i // {K}) * {K} END)::INT AS seed FROM (SELECT id, a, unnest(range(0, length(a) + 1)) AS i FROM p)")
def seed_potential(p: DataFrame) -> DataFrame:
    at = p.select("id", "a", F.explode(F.sequence(F.lit(0), F.length("a"))).alias("i"))
    return at.select("id", "i", expr.potential(F.length("a"), "i", K).alias("potential"), S.covering_seed(F.col("i"), F.length("a"), K).alias("seed"))


_T = f"""t AS (
  SELECT m.*, length(a) AS n, length(b) AS o, (start_i - start_j - {_p_sql('start_i')})::INT AS start_ti, (start_j - start_i - {_p_sql('start_i')})::INT AS start_tj,
         (end_i - end_j - {_p_sql('end_i')})::INT AS end_ti, (end_j - end_i - {_p_sql('end_i')})::INT AS end_tj
  FROM m JOIN p USING (id))"""


@query("transform", f"WITH {_SEEDS}, {_KMERS}, {_MATCHES}, {_T} SELECT id, start_i, start_j, start_ti, start_tj, end_ti, end_tj FROM t")
def transform(p: DataFrame) -> DataFrame:
    return S.transformed(p, K).select("id", "start_i", "start_j", "start_ti", "start_tj", "end_ti", "end_tj")


@query("matches_tfilter", f"WITH {_SEEDS}, {_KMERS}, {_MATCHES}, {_T} SELECT id, start_i, start_j, end_i, end_j, 0::INT AS match_cost, 1::INT AS seed_potential FROM t WHERE start_ti <= n - o AND start_tj <= o - n")
def matches_tfilter(p: DataFrame) -> DataFrame:
    return S.target_filter(p, K)


_LETTERS = "(SELECT unnest(['A', 'C', 'G', 'T']) AS c)"
_S5 = f"s AS (SELECT id, (t * {K2})::INT AS start, substring(a, (t * {K2} + 1)::INT, {K2}) AS q FROM (SELECT id, a, unnest(range(0, length(a) // {K2})) AS t FROM p))"
_MUT = f"""u AS (
  SELECT DISTINCT q, 'del' AS kind, substring(q, 1, i::INT) || substring(q, i::INT + 2) AS w FROM (SELECT DISTINCT q FROM s), range(0, {K2}) r(i)
  UNION ALL SELECT DISTINCT q, 'sub', substring(q, 1, i::INT) || c || substring(q, i::INT + 2) FROM (SELECT DISTINCT q FROM s), range(0, {K2}) r(i), {_LETTERS} WHERE c <> substring(q, i::INT + 1, 1)
  UNION ALL SELECT DISTINCT q, 'ins', substring(q, 1, i::INT) || c || substring(q, i::INT + 1) FROM (SELECT DISTINCT q FROM s), range(0, {K2} + 1) r(i), {_LETTERS})"""
_INEXACT = f"""{_S5}, {_MUT},
w AS (SELECT id, start, q AS w, 0 AS c FROM s UNION ALL SELECT s.id, s.start, u.w, 1 FROM s JOIN u USING (q)),
k AS (SELECT id, j::INT AS j, substring(b, (j + 1)::INT, l::INT) AS q FROM (SELECT id, b, l, unnest(range(0, length(b) - l + 1)) AS j FROM p, range({K2 - 1}, {K2 + 2}) r(l))),
m AS (SELECT w.id, w.start AS start_i, k.j AS start_j, w.start + {K2} AS end_i, (k.j + length(k.q))::INT AS end_j, min(w.c)::INT AS match_cost, 2::INT AS seed_potential
      FROM w JOIN k ON w.id = k.id AND w.w = k.q GROUP BY ALL)"""


@query("mutations", f"WITH {_S5}, {_MUT} SELECT q, kind, w FROM u")
def mutations(p: DataFrame) -> DataFrame:
    q = S.seeds(p, K2).select("q").distinct()
    return q.select("q", F.explode(S.mutations(F.col("q"), K2)).alias("m")).select("q", "m.kind", F.col("m.q").alias("w"))


@query("matches_inexact", f"WITH {_INEXACT} SELECT * FROM m", heavy=True)
def matches_inexact(p: DataFrame) -> DataFrame:
    return S.matches_inexact(p, K2)


@query(
    "consistency_closure",
    f"""WITH {_INEXACT},
x AS (SELECT id, start_i, start_j + ds AS start_j, end_i, end_j + de AS end_j, match_cost + 1 AS match_cost, seed_potential
      FROM m, (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) d(ds, de) WHERE match_cost + 1 < seed_potential)
SELECT * FROM m UNION ALL SELECT x.* FROM x ANTI JOIN m USING (id, start_i, start_j, end_i, end_j, match_cost)""", heavy=True,
)
def consistency_closure(p: DataFrame) -> DataFrame:
    return S.consistent_matches(p, K2)


@query("seed_costs", f"WITH {_INEXACT} SELECT s.id, s.start, s.start + {K2} AS \"end\", 2::INT AS seed_potential, coalesce(c.c, 2)::INT AS seed_cost FROM s LEFT JOIN (SELECT id, start_i, min(match_cost) AS c FROM m GROUP BY 1, 2) c ON s.id = c.id AND s.start = c.start_i", heavy=True)
def seed_costs(p: DataFrame) -> DataFrame:
    return S.seed_costs(p, K2, 2)


@query("suffix_potentials", f"WITH {_SEEDS} SELECT id, start, {_p_sql('start', 'n')}::BIGINT AS potential FROM (SELECT s.*, length(a) AS n FROM s JOIN p USING (id))")
def suffix_potentials(p: DataFrame) -> DataFrame:
    return S.suffix_potentials(S.seeds(p, K)).select("id", "start", "potential")


@query("matches_in_order", f"WITH {_SEEDS}, {_KMERS}, {_MATCHES} SELECT id, start_i, start_j, end_i, end_j, (row_number() OVER (PARTITION BY id ORDER BY start_i, start_j, end_i, end_j) - 1)::INT AS place FROM m")
def matches_in_order(p: DataFrame) -> DataFrame:
    return S.in_order(S.matches(p, K)).select("id", "start_i", "start_j", "end_i", "end_j", "place")


_P2 = lambda c: _p_sql(c, "n", K2, 2)


@query("matches_built", f"WITH {_INEXACT}, t AS (SELECT m.*, length(a) AS n, length(b) AS o FROM m JOIN p USING (id)) SELECT id, start_i, start_j, end_i, end_j, match_cost, seed_potential, (min(match_cost) OVER (PARTITION BY id, start_i))::INT AS seed_cost FROM t WHERE start_i - start_j - {_P2('start_i')} <= n - o AND start_j - start_i - {_P2('start_i')} <= o - n", heavy=True)
def matches_built(p: DataFrame) -> DataFrame:
    return S.built(p, K2, 2, gaps=True)


@query("matches_locally_pruned")
def matches_locally_pruned(p: DataFrame) -> DataFrame:
    """Which matches stay depends on those kept before: no SQL, but a brute-force version in the tests."""
    return S.matches(p, K, 1, look_ahead=3)


_MOST = 2
_HITS = "len([1 FOR x IN range(1, length(b) - length({s}) + 2) IF substring(b, x::INT, length({s})) = {s}])"
_GROWN_SQL = f"""
w AS (SELECT id, a, b, length(a) AS i, length(a) AS stop, length(a) AS was, -1::BIGINT AS n FROM p
      UNION ALL SELECT id, a, b, i, CASE WHEN n <= {_MOST} THEN i ELSE stop END, stop, n
      FROM (SELECT id, a, b, i, stop, {_HITS.format(s="s")} AS n FROM (SELECT id, a, b, i - 1 AS i, stop, substring(a, i::INT, (stop - i + 1)::INT) AS s FROM w WHERE i > 0))),
grown AS (SELECT id, a, b, i AS start, was AS stop, n FROM w WHERE n BETWEEN 0 AND {_MOST})"""


@query("grown_seeds", f"WITH RECURSIVE {_GROWN_SQL} SELECT id, start::INT AS start, stop::INT AS \"end\", n::INT AS n_matches, 1::INT AS seed_potential, (count(*) OVER (PARTITION BY id ORDER BY start DESC))::BIGINT AS potential FROM grown")
def grown_seeds(p: DataFrame) -> DataFrame:
    return S.suffix_potentials(S.grown_seeds(p, _MOST))


@query("grown_matches", f"WITH RECURSIVE {_GROWN_SQL} SELECT id, start::INT AS start_i, (x - 1)::INT AS start_j, stop::INT AS end_i, (x - 1 + stop - start)::INT AS end_j, 0::INT AS match_cost, 1::INT AS seed_potential FROM (SELECT *, unnest([x FOR x IN range(1, length(b) - (stop - start) + 2) IF substring(b, x::INT, (stop - start)::INT) = substring(a, (start + 1)::INT, (stop - start)::INT)]) AS x FROM grown)")
def grown_matches(p: DataFrame) -> DataFrame:
    return S.grown_matches(p, _MOST)


@query("matches_in_cone", f"WITH {_SEEDS}, {_KMERS}, {_MATCHES} SELECT m.*, 0::INT AS match_cost, 1::INT AS seed_potential FROM m JOIN p USING (id) WHERE start_i - start_j - greatest(length(a) // {K} - (start_i + {K} - 1) // {K}, 0) <= length(a) - length(b) AND start_j - start_i - greatest(length(a) // {K} - (start_i + {K} - 1) // {K}, 0) <= length(b) - length(a)", heavy=True)
def matches_in_cone(p: DataFrame) -> DataFrame:
    return S.matches_in_cone(p, K)


@query("seed_flags", f"SELECT id, i::INT AS i, (CASE WHEN i > 0 AND (i - 1) // {K} < length(a) // {K} THEN (i - 1) // {K} * {K} END)::INT AS ending, (i // {K} < length(a) // {K} AND i % {K} = 0) AS is_start, (i > 0 AND i % {K} = 0 AND i <= length(a) // {K} * {K}) AS is_end FROM (SELECT id, a, unnest(range(0, length(a) + 1)) AS i FROM p)")
def seed_flags(p: DataFrame) -> DataFrame:
    at = p.select("id", F.length("a").alias("n"), F.explode(F.sequence(F.lit(0), F.length("a"))).alias("i"))
    i, n = F.col("i"), F.col("n")
    return at.select("id", "i", S.ending_seed(i, n, K).alias("ending"), S.is_seed_start(i, n, K).alias("is_start"), S.is_seed_end(i, n, K).alias("is_end"))


@query("inverse_transform", f"SELECT id, i::INT AS i, j::INT AS j FROM (SELECT id, unnest([x FOR x IN range(0, length(a) + 1) IF x % {K} = 0 AND x < length(a) // {K} * {K} OR x = length(a)]) AS i, length(b) // 2 AS j FROM p)")
def inverse_transform(p: DataFrame) -> DataFrame:
    """There and back, for every seed's start and the end."""
    n = F.length("a")
    at = p.select("id", n.alias("n"), F.floor(F.length("b") / 2).cast("int").alias("j"), F.explode(F.filter(F.sequence(F.lit(0), n), lambda i: ((i % K == 0) & (i < F.floor(n / K) * K)) | (i == n))).alias("i"))
    h = expr.potential("n", "i", K)
    back = expr.inverse_transformed(expr.transformed_i("i", "j", h), expr.transformed_j("i", "j", h), "n", K)
    return at.select("id", back["i"].alias("i"), back["j"].alias("j"))


def _pd_sql(i: str, to: str) -> str:
    end = f"CASE WHEN {to} // {K} < length(a) // {K} THEN {to} // {K} * {K} ELSE {to} END"
    return f"({_p_sql(i)} - {_p_sql('(' + end + ')')})"


@query("potential_distance", f"SELECT id, i::INT AS i, {_pd_sql('i', 'least(i + 7, length(a))')}::INT AS potential, (least(i + 7, length(a)) // {K} - (i + {K - 1}) // {K} + abs((least(i + 7, length(a)) - i) - 5))::INT AS bound FROM (SELECT id, a, unnest(range(0, length(a) + 1)) AS i FROM p)")
def potential_distance(p: DataFrame) -> DataFrame:
    """From each place to 7 letters of a on; and the affine gap bound, for 5 letters of b."""
    at = p.select("id", F.length("a").alias("n"), F.explode(F.sequence(F.lit(0), F.length("a"))).alias("i"))
    to = F.least(F.col("i") + 7, F.col("n"))
    return at.select("id", "i", expr.potential_distance("n", "i", to, K).cast("int").alias("potential"), expr.affine_gap_bound("i", F.lit(0), to, F.lit(5), K).alias("bound"))


# --- bounds from matches ---------------------------------------------------------------------------------------------


@query("sh_h0", f"WITH {_SEEDS}, {_KMERS}, f AS (SELECT DISTINCT id, q FROM k) SELECT p.id, (count(s.q) - count(f.q))::INT AS h FROM p LEFT JOIN s ON p.id = s.id LEFT JOIN f ON s.id = f.id AND s.q = f.q GROUP BY p.id")
def sh_h0(p: DataFrame) -> DataFrame:
    return H.sh(p, K)


def _chain_sql(source: str, start: tuple[str, str], end: tuple[str, str], score: str = "1") -> str:
    """r(id, v): the best chain's score, adding one match at a time from the last start on."""
    (si, sj), (ei, ej) = start, end
    return f"""
o AS (SELECT id, {si} AS si, {sj} AS sj, {ei} AS ei, {ej} AS ej, {score} AS score, row_number() OVER (PARTITION BY id ORDER BY {si} + {sj} DESC, {si} DESC, {sj} DESC) AS k FROM {source}),
g AS (
  SELECT id, 1::BIGINT AS k, [{{'i': si, 'j': sj, 'v': score::BIGINT}}] AS st FROM o WHERE k = 1
  UNION ALL
  SELECT g.id, o.k, list_append(g.st, {{'i': o.si, 'j': o.sj, 'v': o.score + coalesce(list_max([x.v FOR x IN g.st IF x.i >= o.ei AND x.j >= o.ej]), 0)}})
  FROM g JOIN o ON o.id = g.id AND o.k = g.k + 1),
r AS (SELECT id, max(list_max([x.v FOR x IN st])) AS v FROM g GROUP BY id)"""


@query("csh_h0", f"WITH RECURSIVE {_SEEDS}, {_KMERS}, {_MATCHES}, {_chain_sql('m', ('start_i', 'start_j'), ('end_i', 'end_j'))} SELECT p.id, ({_p_sql('0')} - coalesce(r.v, 0))::INT AS h FROM p LEFT JOIN r USING (id)")
def csh_h0(p: DataFrame) -> DataFrame:
    return H.csh(p, K)


@query(
    "gcsh_h0",
    f"WITH RECURSIVE {_SEEDS}, {_KMERS}, {_MATCHES}, {_T}, f AS (SELECT * FROM t WHERE start_ti <= n - o AND start_tj <= o - n AND end_ti <= n - o AND end_tj <= o - n), {_chain_sql('f', ('start_ti', 'start_tj'), ('end_ti', 'end_tj'))} SELECT p.id, (CASE WHEN r.v IS NULL THEN greatest(abs(length(a) - length(b)), {_p_sql('0')}) ELSE {_p_sql('0')} - r.v END)::INT AS h FROM p LEFT JOIN r USING (id)",
)
def gcsh_h0(p: DataFrame) -> DataFrame:
    return H.gcsh(p, K)


# Places from which the bounds are asked for, as far as they lie within the pair; each pair's ends are one.
_PLACES = ((0, 0), (1, 0), (3, 5), (8, 8), (9, 12), (16, 15), (24, 20), (40, 41))
_AT_SQL = f"pl AS (SELECT id, n, o, x.i AS i, x.j AS j FROM (SELECT id, length(a) AS n, length(b) AS o, unnest(list_append([{', '.join(f'{{{chr(39)}i{chr(39)}: {i}::BIGINT, {chr(39)}j{chr(39)}: {j}::BIGINT}}' for i, j in _PLACES)}], {{'i': length(a), 'j': length(b)}})) AS x FROM p) WHERE x.i <= n AND x.j <= o)"


def _places(p: DataFrame) -> Column:
    own = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in _PLACES]
    ends = F.struct(F.length("a").alias("i"), F.length("b").alias("j"))
    return F.filter(F.array(*own, ends), lambda x: (x["i"] <= F.length("a")) & (x["j"] <= F.length("b")))


def _from_sql(best: str, at: str, i: str, j: str) -> str:
    """Chains from each place on: v, null where there is none."""
    return f"z AS (SELECT id, arg_max(st, k) AS st FROM g GROUP BY id), w AS (SELECT pl.id, pl.i, pl.j, pl.n, pl.o, ({at}) AS p, list_max([x.v FOR x IN z.st IF x.i >= {i} AND x.j >= {j}]) AS v FROM pl LEFT JOIN z USING (id)) SELECT id, i::INT AS i, j::INT AS j, ({best})::INT AS h FROM w"


_P_AT = f"greatest(n // {K} - (i + {K} - 1) // {K}, 0)"


@query("sh_at", f"WITH {_SEEDS}, {_KMERS}, f AS (SELECT DISTINCT id, q FROM k), {_AT_SQL} SELECT pl.id, pl.i::INT AS i, pl.j::INT AS j, (SELECT count(*) FROM s LEFT JOIN f ON s.id = f.id AND s.q = f.q WHERE s.id = pl.id AND s.start >= pl.i AND f.q IS NULL)::INT AS h FROM pl")
def sh_at(p: DataFrame) -> DataFrame:
    return H.at_places(p, _places(p), "sh", K, 1)


@query("csh_at", f"WITH RECURSIVE {_SEEDS}, {_KMERS}, {_MATCHES}, {_chain_sql('m', ('start_i', 'start_j'), ('end_i', 'end_j'))}, {_AT_SQL}, {_from_sql('p - coalesce(v, 0)', _P_AT, 'pl.i', 'pl.j')}")
def csh_at(p: DataFrame) -> DataFrame:
    return H.at_places(p, _places(p), "csh", K, 1)


@query(
    "gcsh_at",
    f"WITH RECURSIVE {_SEEDS}, {_KMERS}, {_MATCHES}, {_T}, f AS (SELECT * FROM t WHERE start_ti <= n - o AND start_tj <= o - n AND end_ti <= n - o AND end_tj <= o - n), {_chain_sql('f', ('start_ti', 'start_tj'), ('end_ti', 'end_tj'))}, {_AT_SQL}, {_from_sql('CASE WHEN v IS NULL THEN greatest(abs((n - i) - (o - j)), p) ELSE p - v END', _P_AT, f'pl.i - pl.j - {_P_AT}', f'pl.j - pl.i - {_P_AT}')}",
)
def gcsh_at(p: DataFrame) -> DataFrame:
    return H.at_places(p, _places(p), "gcsh", K, 1)


_LONG_PART = "translate(md5(concat('{t}:', cast(s_suppkey as string))), '0123456789abcdef', 'ACGTACGTACGTACGT')"


def very_long_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, a, b) of every supplier: 5,000 letters, with many small edits, or one large one."""
    suppliers = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").cast("bigint").alias("id"), "s_suppkey")
    a = suppliers.select("id", F.expr(f"substring(concat({', '.join(_LONG_PART.format(t=t) for t in range(157))}), 1, 5000)").alias("a"))
    edits = "CASE id % 3 WHEN 0 THEN replace(replace(a, 'ACGA', 'AGA'), 'TTCT', 'TTGGCT') WHEN 1 THEN replace(replace(a, 'CGG', 'CAG'), 'GATT', '') ELSE concat(substring(a, 1, 900), repeat('ACGTTTGACA', 30), substring(a, 1400)) END"
    return dealt(a, "id").withColumn("b", F.expr(edits))  # few rows with much work each


@query("long_affine_align", with_pairs=False)
def long_affine_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of pairs of 5,000 letters: cost, cost of the script's own parts, and what it consumes. SQL over whole grids would take
    hours; a test compares with a grid that is filled row by row."""
    s = very_long_pairs(spark, sf_dir).select("id", A.affine_align("a", "b", cost_model.affine(1, 2, 1)).alias("r")).select("id", "r.cost", F.col("r.cigar").alias("s"))
    count = lambda ops: F.aggregate(F.filter("s", lambda e: e["op"].isin(*ops)), F.lit(0), lambda x, e: x + e["cnt"])
    return s.select("id", "cost", (count("X") + 2 * count("O") + count("ID")).alias("script_cost"), count("=XD").alias("used_a"), count("=XI").alias("used_b"))


_SH_SQL = "f0 AS (SELECT DISTINCT id, q FROM k), sh AS (SELECT p.id, (count(s.q) - count(f0.q))::INT AS sh FROM p LEFT JOIN s ON p.id = s.id LEFT JOIN f0 ON s.id = f0.id AND s.q = f0.q GROUP BY p.id)"


@query("seed_bounds", f"WITH RECURSIVE {_SEEDS}, {_KMERS}, {_MATCHES}, {_SH_SQL}, {_chain_sql('m', ('start_i', 'start_j'), ('end_i', 'end_j'))} SELECT p.id, sh.sh, ({_p_sql('0')} - coalesce(r.v, 0))::INT AS csh, levenshtein(a, b)::INT AS cost FROM p JOIN sh USING (id) LEFT JOIN r USING (id)")
def seed_bounds(p: DataFrame) -> DataFrame:
    """Each bound is at most the next, and all at most the distance."""
    out = p.select("id", expr.distance("a", "b").alias("cost"))
    for kind in ("sh", "csh"):
        out = out.join(H.bound(p, kind, K, 1).withColumnRenamed("h", kind), "id")
    return out


def _inexact_gcsh_sql(n: str, o: str) -> str:
    """hs(id, h): gcsh with seeds of one edit, of p with a's length n and b's o."""
    at = lambda c: _p_sql(c, "n", K2, 2)
    points = ", ".join(f"({e}_i - {e}_j - {at(e + '_i')})::INT AS {e}_ti, ({e}_j - {e}_i - {at(e + '_i')})::INT AS {e}_tj" for e in ("start", "end"))
    near = "start_ti <= n - o AND start_tj <= o - n AND end_ti <= n - o AND end_tj <= o - n AND match_cost < 2"
    return f"""{_INEXACT},
t AS (SELECT *, {points} FROM (SELECT m.*, length({n}) AS n, length({o}) AS o FROM m JOIN p USING (id))),
f AS (SELECT *, 2 - match_cost AS score FROM t WHERE {near}),
{_chain_sql("f", ("start_ti", "start_tj"), ("end_ti", "end_tj"), "score")},
hs AS (SELECT p.id, (CASE WHEN r.v IS NULL THEN greatest(abs(length(a) - length(b)), {_p_sql("0", "length(a)", K2, 2)}) ELSE {_p_sql("0", "length(a)", K2, 2)} - r.v END)::INT AS h FROM p LEFT JOIN r USING (id))"""


@query("gcsh_inexact_h0", f"WITH RECURSIVE {_inexact_gcsh_sql('a', 'b')} SELECT id, h FROM hs", heavy=True)
def gcsh_inexact_h0(p: DataFrame) -> DataFrame:
    return H.bound(p, "gcsh", K2, 2)


_SWAPPED = f"WITH RECURSIVE p AS (SELECT id, b AS a, a AS b FROM ({PAIRS_SQL})), "


@query("gcsh_mirrored_h0", f"{_SWAPPED}{_inexact_gcsh_sql('a', 'b')} SELECT id, h FROM hs", with_pairs=False)
def gcsh_mirrored_h0(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.mirrored("gcsh", pairs(spark, sf_dir), K2, 2)


_BOTH_SH = "s AS (SELECT id, side, unnest([substring(a, (t * {k} + 1)::INT, {k}) FOR t IN range(0, length(a) // {k})]) AS q FROM both_), k AS (SELECT DISTINCT id, side, unnest([substring(b, (j + 1)::INT, {k}) FOR j IN range(0, length(b) - {k} + 1)]) AS q FROM both_)".format(k=K)


@query("symmetric_sh_h0", f"WITH both_ AS (SELECT id, 0 AS side, a, b FROM p UNION ALL SELECT id, 1, b, a FROM p), {_BOTH_SH}, h AS (SELECT s.id, s.side, count(*) - count(k.q) AS h FROM s LEFT JOIN k USING (id, side, q) GROUP BY ALL) SELECT p.id, coalesce(max(h.h), 0)::INT AS h FROM p LEFT JOIN h USING (id) GROUP BY p.id")
def symmetric_sh_h0(p: DataFrame) -> DataFrame:
    return H.symmetric("sh", p, K)


@query("bounds_by_name", "SELECT id, name, (CASE name WHEN 'gap' THEN abs(length(a) - length(b)) ELSE 0 END)::INT AS h FROM p, (SELECT unnest(['none', 'zero', 'gap']) AS name)")
def bounds_by_name(p: DataFrame) -> DataFrame:
    out = [H.bound(p, name).withColumn("name", F.lit(name)) for name in ("none", "zero", "gap")]
    return out[0].unionByName(out[1]).unionByName(out[2])


# --- cost models -----------------------------------------------------------------------------------------------------


def _model_sql(model: cost_model.CostModel) -> str:
    """All pairs' grids, a row for each step: m, and a list d for each deletion layer."""
    big = 1 << 20
    sub = big if model.sub is None else model.sub
    ins, dels = model.gaps("ins"), model.gaps("del")
    prefix = lambda t: f"[least({', '.join(['list_extract(' + t + ', j + 1)'] + [f'coalesce(list_min([list_extract({t}, q + 1) + {o} + {e} * (j - q) FOR q IN range(0, j)]), {big})' for o, e in ins])}) FOR j IN range(0, length(b) + 1)]"
    first = f"[least({', '.join([f'CASE WHEN j = 0 THEN 0 ELSE {big} END'] + [f'CASE WHEN j = 0 THEN 0 ELSE {o} + {e} * j END' for o, e in ins])}) FOR j IN range(0, length(b) + 1)]"
    d_next = [f"[least(list_extract(d{g}, j + 1), list_extract(m, j + 1) + {o}) + {e} FOR j IN range(0, length(b) + 1)] AS d{g}" for g, (o, e) in enumerate(dels)]
    least = ", ".join([f"CASE WHEN j = 0 THEN {big} ELSE list_extract(m, j) + CASE WHEN substring(b, j::INT, 1) = substring(a, i::INT + 1, 1) THEN 0 ELSE {sub} END END"] + [f"list_extract(d{g}, j + 1)" for g in range(len(dels))])
    names = "".join(f", d{g}" for g in range(len(dels)))
    start = "".join(f", [{big} FOR j IN range(0, length(b) + 1)] AS d{g}" for g in range(len(dels)))
    return f"""
g AS (
  SELECT id, a, b, 0 AS i, {first} AS m{start} FROM p
  UNION ALL
  SELECT id, a, b, i + 1, {prefix("t")}, {names[2:]}
  FROM (SELECT id, a, b, i{names}, [least({least}) FOR j IN range(0, length(b) + 1)] AS t
        FROM (SELECT id, a, b, i, m, {", ".join(d_next)} FROM g WHERE i < length(a))))"""


MODELS = {
    "lcs_distance": cost_model.lcs(),
    "linear_distance": cost_model.linear(1, 3),
    "asymmetric_distance": cost_model.linear_asymmetric(1, 2, 3),
    "affine_distance": cost_model.affine(1, 2, 1),
    "linear_affine_distance": cost_model.linear_affine(1, 3, 2, 1),
    "affine_asymmetric_distance": cost_model.affine_asymmetric(1, 2, 2, 3, 1),
    "double_affine_distance": cost_model.double_affine(1, 4, 2, 10, 1),
}
for _name, _model in MODELS.items():
    query(_name, f"WITH RECURSIVE {_model_sql(_model)} SELECT id, (list_extract(m, length(b) + 1))::INT AS cost FROM g WHERE i = length(a)")(lambda p, model=_model: p.select("id", A.alignment_cost("a", "b", model).alias("cost")))


@query("affine_script_check", f"WITH RECURSIVE {_model_sql(cost_model.affine(1, 2, 1))} SELECT id, (list_extract(m, length(b) + 1))::INT AS cost, length(a)::INT AS used_a, length(b)::INT AS used_b FROM g WHERE i = length(a)")
def affine_script_check(p: DataFrame) -> DataFrame:
    """The cost that the script's own parts add up to, and what it consumes."""
    s = p.select("id", A.affine_align("a", "b", cost_model.affine(1, 2, 1))["cigar"].alias("s"))
    count = lambda ops: F.aggregate(F.filter("s", lambda e: e["op"].isin(*ops)), F.lit(0), lambda x, e: x + e["cnt"])
    return s.select("id", (count("X") + 2 * count("O") + count("ID")).alias("cost"), count("=XD").alias("used_a"), count("=XI").alias("used_b"))


def _deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A change of diagonal from -20 to 20 for every order."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return orders.select(F.col("o_orderkey").cast("bigint").alias("id"), (F.col("o_orderkey") % 41 - 20).cast("int").alias("delta"))


_DELTAS_SQL = "(SELECT o_orderkey::BIGINT AS id, o_orderkey % 41 - 20 AS d FROM orders)"


@query("gap_costs", f"SELECT id, d::INT AS delta, (CASE WHEN d = 0 THEN 0 WHEN d < 0 THEN 2 + 2 * -d ELSE 3 + d END)::INT AS cost, least(abs(d) * 3, CASE WHEN d = 0 THEN 0 ELSE 2 + abs(d) END)::INT AS mixed FROM {_DELTAS_SQL}", with_pairs=False)
def gap_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    models = {"cost": cost_model.affine_asymmetric(1, 2, 2, 3, 1), "mixed": cost_model.linear_affine(1, 3, 2, 1)}
    return _deltas(spark, sf_dir).select("id", "delta", *[expr.gap_cost(m, "delta").alias(n) for n, m in models.items()])


# --- edit scripts ----------------------------------------------------------------------------------------------------


@query("align_cost_check", "SELECT id, levenshtein(a, b)::INT AS cost, levenshtein(a, b)::INT AS script_cost, true AS ok FROM p")
def align_cost_check(p: DataFrame) -> DataFrame:
    s = p.withColumn("r", A.align("a", "b"))
    return s.select("id", F.col("r.cost").alias("cost"), cigar.cost("r.cigar").alias("script_cost"), cigar.valid("r.cigar", "a", "b").alias("ok"))


@query("bounded_align", f"SELECT id, levenshtein(a, b)::INT AS cost, length(a)::INT AS used_a, length(b)::INT AS used_b FROM p WHERE levenshtein(a, b) <= {BOUND}")
def bounded_align(p: DataFrame) -> DataFrame:
    s = p.withColumn("r", A.bounded_align("a", "b", BOUND)).where("r is not null")
    return s.select("id", F.col("r.cost").alias("cost"), cigar.count_of("r.cigar", "=XD").alias("used_a"), cigar.count_of("r.cigar", "=XI").alias("used_b"))


@query("cigar_op_counts", "SELECT id, (length(a) - length(b))::INT AS surplus, levenshtein(a, b)::INT AS edits FROM p")
def cigar_op_counts(p: DataFrame) -> DataFrame:
    s = p.select("id", A.align("a", "b")["cigar"].alias("s"))
    return s.select("id", (cigar.count_of("s", "D") - cigar.count_of("s", "I")).alias("surplus"), cigar.count_of("s", "XID").alias("edits"))


@query("cigar_path", "SELECT id, length(a)::INT AS i, length(b)::INT AS j, levenshtein(a, b)::INT AS cost, true AS starts FROM p")
def cigar_path(p: DataFrame) -> DataFrame:
    s = p.select("id", cigar.path(A.align("a", "b")["cigar"]).alias("w"))
    end = F.element_at("w", -1)
    return s.select("id", end["i"].alias("i"), end["j"].alias("j"), end["cost"].alias("cost"), ((F.get("w", F.lit(0))["i"] == 0) & (F.get("w", F.lit(0))["j"] == 0)).alias("starts"))


_GRID_SQL = """
g AS (
  SELECT id, a, b, 0 AS i, [j FOR j IN range(0, length(b) + 1)] AS m, [[j FOR j IN range(0, length(b) + 1)]] AS rows FROM p
  UNION ALL
  SELECT id, a, b, i, m, list_append(rows, m) FROM (
    SELECT id, a, b, i, [list_min([list_extract(t, q + 1) + j - q FOR q IN range(0, j + 1)]) FOR j IN range(0, length(b) + 1)] AS m, rows FROM (
      SELECT id, a, b, i + 1 AS i, [CASE WHEN j = 0 THEN i + 1 ELSE least(list_extract(m, j + 1) + 1, list_extract(m, j) + CASE WHEN b[j] = a[i + 1] THEN 0 ELSE 1 END) END FOR j IN range(0, length(b) + 1)] AS t, rows FROM g WHERE i < length(a)))),
d AS (SELECT id, a, b, rows FROM g WHERE i = length(a)),
w AS (
  SELECT id, length(a) AS i, length(b) AS j, '' AS s FROM d
  UNION ALL
  SELECT id, i - CASE WHEN op = 'I' THEN 0 ELSE 1 END, j - CASE WHEN op = 'D' THEN 0 ELSE 1 END, op || s FROM (
    SELECT w.id, i, j, s, CASE WHEN i > 0 AND j > 0 AND a[i] = b[j] THEN '=' WHEN j > 0 AND rows[i + 1][j] + 1 = rows[i + 1][j + 1] THEN 'I' WHEN i > 0 AND rows[i][j + 1] + 1 = rows[i + 1][j + 1] THEN 'D' ELSE 'X' END AS op
    FROM w JOIN d USING (id) WHERE i > 0 OR j > 0)),
x AS (SELECT id, s FROM w WHERE i = 0 AND j = 0)"""


def _letters_of(script: Column) -> Column:
    return F.array_join(F.flatten(F.transform(script, lambda e: F.array_repeat(e["op"], e["cnt"]))), "")


@query("edit_script", f"WITH RECURSIVE {_GRID_SQL} SELECT id, s FROM x")
def edit_script(p: DataFrame) -> DataFrame:
    """Whole scripts, a letter for each step."""
    return p.select("id", _letters_of(A.align("a", "b")["cigar"]).alias("s"))


@query("edit_path", f"WITH RECURSIVE {_GRID_SQL} SELECT id, t::INT AS step, length(replace(substring(s, 1, t::INT), 'I', ''))::INT AS i, length(replace(substring(s, 1, t::INT), 'D', ''))::INT AS j, length(replace(substring(s, 1, t::INT), '=', ''))::INT AS cost FROM (SELECT id, s, unnest(range(0, length(s) + 1)) AS t FROM x)")
def edit_path(p: DataFrame) -> DataFrame:
    """Every position of every script."""
    return p.select("id", F.explode(cigar.path(A.align("a", "b")["cigar"])).alias("w")).select("id", "w.*")


@query("explained_steps", f"WITH RECURSIVE {_GRID_SQL} SELECT id, t::INT AS step, CASE WHEN t > 0 THEN s[t] END AS op FROM (SELECT id, s, unnest(range(0, length(s) + 1)) AS t FROM x)")
def explained_steps(p: DataFrame) -> DataFrame:
    return reports.explain_alignment(p).select("id", "step", "op")


_PATH_SQL = f"path AS (SELECT id, i, j, total - cost AS left_ FROM (WITH RECURSIVE {_GRID_SQL} SELECT id, length(replace(substring(s, 1, t::INT), 'I', '')) AS i, length(replace(substring(s, 1, t::INT), 'D', '')) AS j, length(replace(substring(s, 1, t::INT), '=', '')) AS cost, length(replace(s, '=', '')) AS total FROM (SELECT id, s, unnest(range(0, length(s) + 1)) AS t FROM x)))"


@query(
    "matches_kept_by_path",
    f"WITH RECURSIVE {_SEEDS}, {_KMERS}, {_MATCHES}, {_chain_sql('m', ('start_i', 'start_j'), ('end_i', 'end_j'))}, z AS (SELECT id, arg_max(st, k) AS st FROM g GROUP BY id), {_PATH_SQL} "
    f"SELECT m.id, start_i, start_j, end_i, end_j, 0::INT AS match_cost, 1::INT AS seed_potential FROM m JOIN p USING (id) JOIN z USING (id) LEFT JOIN path ON path.id = m.id AND path.i = start_i AND path.j = start_j WHERE left_ IS NULL OR {_p_sql('start_i')} - list_max([y.v FOR y IN z.st IF y.i >= start_i AND y.j >= start_j]) >= left_", heavy=True,
)
def matches_kept_by_path(p: DataFrame) -> DataFrame:
    return H.kept_by_path(p, K)


@query("explained_in_sql", f"WITH RECURSIVE {_GRID_SQL} SELECT id, t::INT AS step, length(replace(substring(s, 1, t::INT), 'I', ''))::INT AS i, length(replace(substring(s, 1, t::INT), 'D', ''))::INT AS j, length(replace(substring(s, 1, t::INT), '=', ''))::INT AS cost, CASE WHEN t > 0 THEN s[t] END AS op FROM (SELECT id, s, unnest(range(0, length(s) + 1)) AS t FROM x)")
def explained_in_sql(p: DataFrame) -> DataFrame:
    reports.register(p.sparkSession)
    return p.sparkSession.sql("SELECT * FROM seq_explain(TABLE(SELECT id, a, b FROM {p}))", p=p)


_RUNS_SQL = "regexp_extract_all(s, '(=+|X+|I+|D+)')"


@query("cigar_text", f"WITH RECURSIVE {_GRID_SQL} SELECT id, coalesce(list_aggregate([length(r)::VARCHAR || r[1] FOR r IN {_RUNS_SQL}], 'string_agg', ''), '') AS t, len({_RUNS_SQL})::INT AS runs FROM x")
def cigar_text(p: DataFrame) -> DataFrame:
    s = p.select("id", A.align("a", "b")["cigar"].alias("s"))
    return s.select("id", cigar.to_text("s").alias("t"), F.size(cigar.from_text(cigar.to_text("s"))).alias("runs"))


@query("cigar_joined", f"WITH RECURSIVE {_GRID_SQL} SELECT id, s || s AS twice, reverse(s) AS back, length(s || s) - length(replace(s || s, '=', '')) AS equal FROM x")
def cigar_joined(p: DataFrame) -> DataFrame:
    """A script and itself appended, and one reversed, letter by letter."""
    s = p.select("id", A.align("a", "b")["cigar"].alias("s"))
    twice = cigar.appended("s", "s")
    return s.select("id", _letters_of(twice).alias("twice"), _letters_of(cigar.reversed_("s")).alias("back"), cigar.count_of(twice, "=").cast("long").alias("equal"))


@query("cigar_merge", f"WITH RECURSIVE {_GRID_SQL} SELECT id, len(regexp_extract_all(s || s, '(=+|X+|I+|D+)'))::INT AS runs, s || s AS s FROM x")
def cigar_merge(p: DataFrame) -> DataFrame:
    """Runs of one letter each, pushed and joined."""
    s = p.select("id", A.align("a", "b")["cigar"].alias("s"))
    ones = F.flatten(F.transform("s", lambda e: F.array_repeat(F.struct(e["op"].alias("op"), F.lit(1).alias("cnt")), e["cnt"])))
    out = s.select("id", cigar.merged(F.concat(ones, ones)).alias("m"))
    return out.select("id", F.size("m").alias("runs"), _letters_of(F.col("m")).alias("s"))


@query("cigar_to_affine_and_back", f"WITH RECURSIVE {_GRID_SQL} SELECT id, s, (CASE WHEN s <> '' THEN -1 END)::INT AS layers FROM x")
def cigar_to_affine_and_back(p: DataFrame) -> DataFrame:
    s = p.select("id", cigar.to_affine(A.align("a", "b")["cigar"]).alias("s"))
    return s.select("id", _letters_of(cigar.to_base_strictly("s")).alias("s"), F.array_max(F.transform("s", lambda e: e["layer"])).alias("layers"))


@query("alignment_statistics", f"WITH RECURSIVE {_GRID_SQL} SELECT id % 5 AS kind, count(*) AS pairs, avg(length(a)) AS len_a, avg(length(b)) AS len_b, avg(levenshtein(a, b)) AS distance, avg(length(s) - length(replace(s, '=', ''))) AS matches, avg(length(s) - length(replace(s, 'X', ''))) AS substitutions, avg(length(s) - length(replace(s, 'I', ''))) AS insertions, avg(length(s) - length(replace(s, 'D', ''))) AS deletions, avg(len({_RUNS_SQL})) AS runs FROM x JOIN p USING (id) GROUP BY 1")
def alignment_statistics(p: DataFrame) -> DataFrame:
    return reports.alignment_statistics(p.withColumn("kind", F.col("id") % 5), "kind").drop("error_percent")


@query("align_with_statistics", f"WITH RECURSIVE {_GRID_SQL} SELECT id, length(a)::INT AS len_a, length(b)::INT AS len_b, levenshtein(a, b)::INT AS distance, len({_RUNS_SQL})::INT AS runs, (length(s) - length(replace(s, 'X', '')))::INT AS substitutions FROM x JOIN p USING (id)")
def align_with_statistics(p: DataFrame) -> DataFrame:
    s = aligner("full").align_with_statistics(p)
    return s.select("id", *[f"stats.{c}" for c in ("len_a", "len_b", "distance", "runs", "substitutions")])


@query("cigar_to_base", f"WITH RECURSIVE {_model_sql(cost_model.affine(1, 2, 1))} SELECT id, true AS ok, length(a)::INT AS used_a FROM g WHERE i = length(a)")
def cigar_to_base(p: DataFrame) -> DataFrame:
    s = p.select("id", "a", "b", cigar.to_base(A.affine_align("a", "b", cost_model.affine(1, 2, 1))["cigar"]).alias("s"))
    return s.select("id", cigar.valid("s", "a", "b").alias("ok"), cigar.count_of("s", "=XD").alias("used_a"))


@query("bounded_affine_distance", f"WITH RECURSIVE {_model_sql(cost_model.affine(1, 2, 1))} SELECT id, (CASE WHEN list_extract(m, length(b) + 1) <= {BOUND} THEN list_extract(m, length(b) + 1) END)::INT AS cost FROM g WHERE i = length(a)")
def bounded_affine_distance(p: DataFrame) -> DataFrame:
    return p.select("id", A.alignment_cost("a", "b", cost_model.affine(1, 2, 1), BOUND).alias("cost"))


_NEAR = f"list_extract(m, length(b) + 1) <= {BOUND}"


@query("bounded_affine_align", f"WITH RECURSIVE {_model_sql(cost_model.affine(1, 2, 1))} SELECT id, (CASE WHEN {_NEAR} THEN list_extract(m, length(b) + 1) END)::INT AS cost, (CASE WHEN {_NEAR} THEN length(a) END)::INT AS used_a, (CASE WHEN {_NEAR} THEN length(b) END)::INT AS used_b FROM g WHERE i = length(a)")
def bounded_affine_align(p: DataFrame) -> DataFrame:
    s = p.select("id", A.affine_align("a", "b", cost_model.affine(1, 2, 1), BOUND).alias("r"))
    return s.select("id", F.col("r.cost").alias("cost"), cigar.count_of("r.cigar", "=XD").alias("used_a"), cigar.count_of("r.cigar", "=XI").alias("used_b"))


@query("models_from_parts", f"WITH RECURSIVE {_model_sql(cost_model.lcs())} SELECT id, (list_extract(m, length(b) + 1))::INT AS lcs_cost, levenshtein(a, b)::INT AS unit_cost FROM g WHERE i = length(a)")
def models_from_parts(p: DataFrame) -> DataFrame:
    return p.select("id", A.alignment_cost("a", "b", cost_model.from_parts(None, 0, 1)).alias("lcs_cost"), A.alignment_cost("a", "b", cost_model.from_parts(1, 0, 1)).alias("unit_cost"))


@query("long_gap_costs", f"SELECT id, cost::INT AS cost, greatest((cost - 4) // 2, cost - 10, 0)::INT AS longest, greatest(cost // 2, cost)::INT AS opened FROM (SELECT id, d + 20 AS cost FROM {_DELTAS_SQL})", with_pairs=False)
def long_gap_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest gap that a cost pays for, under a model of two layers, new and open already."""
    model, cost = cost_model.double_affine(1, 4, 2, 10, 1), F.col("cost")
    costs = _deltas(spark, sf_dir).select("id", (F.col("delta") + 20).alias("cost"))
    return costs.select("id", "cost", expr.most_for_cost(model, "ins", cost).alias("longest"), expr.most_for_cost(model, "ins", cost, opened=True).alias("opened"))


@query("extend_costs", f"SELECT id, d::INT AS delta, (CASE WHEN d < 0 THEN 2 * -d ELSE d END)::INT AS cost FROM {_DELTAS_SQL}", with_pairs=False)
def extend_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _deltas(spark, sf_dir).select("id", "delta", expr.extend_cost(cost_model.affine_asymmetric(1, 2, 2, 3, 1), "delta").alias("cost"))


#: Models with gaps of one side in a layer, and of the other without, or with none at all.
ONE_SIDED = {"deletions": cost_model.CostModel("deletions", 1, 1, None, (cost_model.Layer("del", 2, 2),)), "insertions": cost_model.CostModel("insertions", 1, None, 1, (cost_model.Layer("ins", 2, 2),))}
for _name, _model in ONE_SIDED.items():
    query(f"one_sided_{_name}", f"WITH RECURSIVE {_model_sql(_model)} SELECT id, (list_extract(m, length(b) + 1))::INT AS cost FROM g WHERE i = length(a)")(lambda p, model=_model: p.select("id", A.alignment_cost("a", "b", model).alias("cost")))


def _scored(model: cost_model.CostModel) -> str:
    return f"WITH RECURSIVE p AS ({PAIRS_SQL}), {_model_sql(model)} SELECT '{model.name}' AS model, id % 5 AS kind, count(*) AS n, sum(list_extract(m, length(b) + 1))::BIGINT AS cost FROM g WHERE i = length(a) GROUP BY 1, 2"


GRID_MODELS = (cost_model.lcs(), cost_model.linear(1, 2), cost_model.affine(1, 2, 1))


@query("cost_model_grid", " UNION ALL ".join(f"SELECT * FROM ({_scored(m)})" for m in GRID_MODELS), with_pairs=False)
def cost_model_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pairs(spark, sf_dir)
    costs = F.array(*[F.struct(F.lit(m.name).alias("model"), A.alignment_cost("a", "b", m).alias("cost")) for m in GRID_MODELS])
    rows = p.select((F.col("id") % 5).alias("kind"), F.explode(costs).alias("c"))
    return rows.groupBy("c.model", "kind").agg(F.count("*").alias("n"), F.sum("c.cost").alias("cost"))


# --- semi-global search ----------------------------------------------------------------------------------------------

_PATTERN = "concat(substring(b, 5, 3), 'N', substring(b, 9, 3), 'Y')"
_SEARCH_SQL = f"""
x AS (SELECT id, a, {_PATTERN} AS q, length({_PATTERN})::INT AS n FROM p),
g AS (
  SELECT id, a, q, n, 0 AS i, [{{u}} FOR j IN range(0, n + 1)] AS m, [] :: BIGINT[] AS o FROM x
  UNION ALL
  SELECT id, a, q, n, i + 1, [list_min([list_extract(t, k + 1) + j - k FOR k IN range(0, j + 1)]) FOR j IN range(0, n + 1)], list_append(o, list_extract(m, n + 1))
  FROM (SELECT id, a, q, n, i, o, m, [CASE WHEN j = 0 THEN 0 ELSE least(list_extract(m, j + 1) + 1, list_extract(m, j) + CASE WHEN substring(q, j::INT, 1) = 'N' OR substring(q, j::INT, 1) = substring(a, i::INT + 1, 1) OR (substring(q, j::INT, 1) = 'Y' AND substring(a, i::INT + 1, 1) IN ('C', 'T')) THEN 0 ELSE 1 END) END FOR j IN range(0, n + 1)] AS t FROM g WHERE i < length(a))),
f AS (SELECT id, n, list_append(o, list_extract(m, n + 1)) || [list_extract(m, j + 1) + {{un}} - {{u}} FOR j IN range(n - 1, -1, -1)] AS c FROM g WHERE i = length(a))"""


def _searched(p: DataFrame, u: float) -> DataFrame:
    return p.select("id", A.search(F.expr(_PATTERN), "a", u).alias("c"))


for _name, _u, _sql in (("semiglobal_costs", 0.0, "0"), ("semiglobal_costs_half", 0.5, "((j + 1) // 2)"), ("semiglobal_costs_full", 1.0, "j")):
    query(_name, f"WITH RECURSIVE {_SEARCH_SQL.format(u=_sql, un=_sql.replace('j', 'n'))} SELECT id, (k - 1)::INT AS idx, list_extract(c, k)::INT AS cost FROM (SELECT id, c, unnest(range(1, len(c) + 1)) AS k FROM f)", heavy=True)(
        lambda p, u=_u: _searched(p, u).select("id", F.posexplode("c").alias("idx", "cost"))
    )


for _name, _u, _sql in (("search_blocks", 0.0, "0"), ("search_blocks_half", 0.5, "((j + 1) // 2)")):
    query(_name, f"WITH RECURSIVE {_SEARCH_SQL.format(u=_sql, un=_sql.replace('j', 'n'))} SELECT id, (k - 1)::BIGINT AS idx, list_extract(c, k)::INT AS cost FROM (SELECT id, c, unnest(range(1, len(c) + 1)) AS k FROM f)", heavy=True)(
        lambda p, u=_u: search_blocks(p.select("id", F.expr(_PATTERN).alias("pattern"), F.col("a").alias("text")), u, 7).select("id", "first", F.posexplode("costs").alias("k", "cost")).select("id", (F.col("first") + F.col("k")).alias("idx"), "cost")
    )


@query("best_hit_per_text", f"WITH RECURSIVE {_SEARCH_SQL.format(u='j', un='n')} SELECT id, list_min(c)::INT AS cost, (list_position(c, list_min(c)) - 1)::INT AS idx FROM f", heavy=True)
def best_hit_per_text(p: DataFrame) -> DataFrame:
    s = _searched(p, 1.0)
    return s.select("id", F.array_min("c").alias("cost"), (F.array_position("c", F.array_min("c")) - 1).cast("int").alias("idx"))


@query("search_trace_check", f"WITH RECURSIVE {_SEARCH_SQL.format(u='0', un='0')} SELECT id, list_min(c)::INT AS cost FROM f", heavy=True)
def search_trace_check(p: DataFrame) -> DataFrame:
    s = p.select("id", "a", F.expr(_PATTERN).alias("q")).withColumn("c", A.search("q", "a", 0.0))
    s = s.withColumn("idx", (F.array_position("c", F.array_min("c")) - 1).cast("int"))
    return s.select("id", cigar.cost(A.search_trace("q", "a", "idx", 0.0)["cigar"]).alias("cost"))


for _name, _u, _sql in (("search_trace_half", 0.5, "((j + 1) // 2)"), ("search_trace_full", 1.0, "j")):

    @query(_name, f"WITH RECURSIVE {_SEARCH_SQL.format(u=_sql, un=_sql.replace('j', 'n'))} SELECT id, list_min(c)::INT AS cost, (CASE WHEN i0 <= la THEN i0 ELSE la END)::INT AS i, (CASE WHEN i0 <= la THEN n ELSE n - (i0 - la) END)::INT AS j FROM (SELECT f.id, c, n, list_position(c, list_min(c)) - 1 AS i0, length(a) AS la FROM f JOIN p ON f.id = p.id)", heavy=True)
    def search_trace_unmatched(p: DataFrame, u: float = _u) -> DataFrame:
        """What the traced script costs, with the pattern's letters left over at both ends; and where the trace ends."""
        s = p.select("id", "a", F.expr(_PATTERN).alias("q")).withColumn("c", A.search("q", "a", u))
        s = s.withColumn("idx", (F.array_position("c", F.array_min("c")) - 1).cast("int")).withColumn("t", A.search_trace("q", "a", "idx", u))
        end = A.index_position("idx", "q", "a")
        left = lambda n: n if u == 1 else F.floor((n + 1) / 2)
        rest = left(F.length("q")) - left(end["j"])
        return s.select("id", (cigar.cost("t.cigar") + left(F.col("t.pattern_start")) + F.when(end["j"] < F.length("q"), rest).otherwise(0)).cast("int").alias("cost"), F.element_at(A.trace_path(F.col("t")), -1)["i"].alias("i"), F.element_at(A.trace_path(F.col("t")), -1)["j"].alias("j"))


@query("search_positions", f"SELECT id, idx::INT AS idx, (CASE WHEN idx <= length(a) THEN idx ELSE length(a) END)::INT AS i, (CASE WHEN idx <= length(a) THEN n ELSE n - (idx - length(a)) END)::INT AS j FROM (SELECT id, a, length({_PATTERN}) AS n, unnest(range(0, length(a) + length({_PATTERN}) + 1)) AS idx FROM p)")
def search_positions(p: DataFrame) -> DataFrame:
    s = p.select("id", "a", F.expr(_PATTERN).alias("q")).withColumn("idx", F.explode(F.sequence(F.lit(0), F.length("a") + F.length("q"))))
    return s.select("id", "idx", A.index_position("idx", "q", "a").alias("at")).select("id", "idx", "at.i", "at.j")


# --- long pairs ------------------------------------------------------------------------------------------------------

_PART = "translate(md5(concat('{t}.', cast(c_custkey as {{string}}))), '0123456789abcdef', 'ACGTACGTACGTACGT')"
_PARTS = ", ".join(_PART.format(t=t) for t in range(17))
LONG_PAIRS = f"""
SELECT id, a, CASE id % 4 WHEN 0 THEN replace(replace(a, 'ACGA', 'AGA'), 'TTC', 'TTGC') WHEN 1 THEN replace(a, 'CG', 'CA')
                          WHEN 2 THEN concat(substring(a, 1, 100), 'ACGTTTGACA', substring(a, 131)) ELSE reverse(a) END AS b
FROM (SELECT cast(c_custkey as bigint) AS id, substring(concat({_PARTS}), 1, CASE c_custkey % 5 WHEN 0 THEN 255 WHEN 1 THEN 256 WHEN 2 THEN 257 WHEN 3 THEN 513 ELSE 515 END) AS a FROM customer) p
"""
LONG_SQL = LONG_PAIRS.replace("{string}", "varchar")


def long_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, a, b) of every customer: 255 to 515 letters; few edits, many substitutions, one long gap, or unlike."""
    customer = dealt(spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey"), "c_custkey")
    return spark.sql(LONG_PAIRS.replace("{string}", "string").replace("FROM customer", "FROM {customer}"), customer=customer)


@query("long_unit_distance", f"SELECT id, levenshtein(a, b)::INT AS cost, (CASE WHEN levenshtein(a, b) <= 60 THEN levenshtein(a, b) END)::INT AS near FROM ({LONG_SQL})", with_pairs=False)
def long_unit_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = long_pairs(spark, sf_dir)
    found = p.select("id", A.long_distance("a", "b").alias("cost"))
    return found.withColumn("near", F.when(F.col("cost") <= 60, F.col("cost")))


@query("long_align", f"SELECT id, levenshtein(a, b)::INT AS cost, levenshtein(a, b)::INT AS script_cost, true AS ok FROM ({LONG_SQL})", with_pairs=False)
def long_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = long_pairs(spark, sf_dir).withColumn("r", A.align("a", "b"))
    return s.select("id", F.col("r.cost").alias("cost"), cigar.cost("r.cigar").alias("script_cost"), cigar.valid("r.cigar", "a", "b").alias("ok"))


@query("long_presets", f"SELECT id, preset, levenshtein(a, b)::INT AS cost FROM ({LONG_SQL}), (SELECT unnest(['default', 'full', 'nw', 'simple']) AS preset)", with_pairs=False)
def long_presets(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, out = long_pairs(spark, sf_dir), None
    for name in sorted(PRESETS):
        own = aligner(name).costs(p).select("id", F.lit(name).alias("preset"), "cost")
        out = own if out is None else out.unionByName(own)
    return out


@query("long_matches", f"WITH p AS ({LONG_SQL}), s AS (SELECT id, t * 8 AS i, substring(a, (t * 8 + 1)::INT, 8) AS q FROM (SELECT id, a, unnest(range(0, length(a) // 8)) AS t FROM p)), k AS (SELECT id, j, substring(b, (j + 1)::INT, 8) AS q FROM (SELECT id, b, unnest(range(0, length(b) - 7)) AS j FROM p)) SELECT id, s.i::INT AS start_i, k.j::INT AS start_j FROM s JOIN k USING (id, q)", with_pairs=False)
def long_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.matches(long_pairs(spark, sf_dir), 8).select("id", "start_i", "start_j")


# --- files, SQL functions and generators -----------------------------------------------------------------------------


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4()}"


def _counted(rows: DataFrame, path: str, *by: str) -> DataFrame:
    """How often rows of the files in path repeat. They are grouped in parts whose number grows with the files, so that no
    task holds more of them as the input grows."""
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), SPLIT_PARTS * spark.read.text(path).rdd.getNumPartitions())
    return rows.repartition(parts, *by).groupBy(*by).agg(F.count("*").alias("n"))


#: Parts of a group-by for each split of the files that are read.
SPLIT_PARTS = 8


@query("read_seq", "SELECT a, b, count(*) AS n FROM p GROUP BY 1, 2", heavy=True)
def read_seq(p: DataFrame) -> DataFrame:
    """Written in the .seq format, and read again."""
    path = _folder(p.sparkSession, "seq")
    write_seq(p, path, ["id"])
    return _counted(read_pairs(p.sparkSession, path, kind="seq"), path, "a", "b")


@query("read_txt", "SELECT a, b, count(*) AS n FROM p GROUP BY 1, 2", heavy=True)
def read_txt(p: DataFrame) -> DataFrame:
    path = _folder(p.sparkSession, "txt")
    p.select(F.concat("a", F.lit("\n"), "b")).write.text(path)
    return _counted(read_pairs(p.sparkSession, path), path, "a", "b")


@query("read_fasta", "SELECT id, a, b FROM p WHERE a <> '' AND b <> ''", heavy=True)
def read_fasta(p: DataFrame) -> DataFrame:
    path = _folder(p.sparkSession, "fasta")
    folded = lambda c: F.regexp_replace(c, "(.{20})", "$1\n")
    p.where("a <> '' AND b <> ''").select(F.concat(F.lit(">"), F.col("id").cast("string"), F.lit(" one\n"), folded("a"), F.lit("\n>"), F.col("id").cast("string"), F.lit(" two\n"), folded("b"))).write.text(path)
    return read_pairs(p.sparkSession, path, kind="fasta").select(F.col("name_a").cast("long").alias("id"), "a", "b")


@query("write_costs", f"WITH RECURSIVE {_GRID_SQL} SELECT levenshtein(a, b)::VARCHAR || ',' || coalesce(list_aggregate([length(r)::VARCHAR || r[1] FOR r IN {_RUNS_SQL}], 'string_agg', ''), '') AS line, count(*) AS n FROM x JOIN p USING (id) GROUP BY 1")
def write_costs_lines(p: DataFrame) -> DataFrame:
    path = _folder(p.sparkSession, "costs")
    write_costs(aligner().align(p).withColumn("cigar", cigar.to_text("cigar")), path, ["id"])
    return _counted(p.sparkSession.read.text(path).withColumnRenamed("value", "line"), path, "line")


@query("simulated_reads", "SELECT 'chr' AS name, id::VARCHAR AS id, substring(b, 3, greatest(length(b) - 3, 0)) AS a, a AS b FROM p WHERE length(b) > 3")
def simulated_reads(p: DataFrame) -> DataFrame:
    """b is the reference with two letters before the part that the read, a, comes from, and one after it."""
    p = p.where("length(b) > 3")
    name = F.concat(F.lit("chr"), F.col("id").cast("string"))
    header = F.concat_ws("_", name, F.lit("2"), F.lit("aligned"), F.col("id").cast("string"), F.lit("F"), F.lit("0"), (F.length("b") - 3).cast("string"), F.lit("0"))
    found = simulated_pairs(p.select(header.alias("header"), F.col("a").alias("sequence")), p.select(name.alias("name"), F.col("b").alias("sequence")))
    return found.select(F.lit("chr").alias("name"), "id", "a", "b")


@query("sql_functions", "SELECT id, levenshtein(a, b)::INT AS cost, levenshtein(a, b)::INT AS simple, levenshtein(a, b)::INT AS whole, levenshtein(a, b)::INT AS seeded, levenshtein(a, b)::INT AS d, length(a)::INT + 2 AS places FROM p")
def sql_functions(p: DataFrame) -> DataFrame:
    A.register(p.sparkSession)
    return p.sparkSession.sql(
        "SELECT id, seq_align(a, b).cost AS cost, seq_align_simple(a, b).cost AS simple, seq_align_full(cast(a AS BINARY), cast(b AS BINARY)).cost AS whole, seq_align_seeded(a, b, 2, 15, false).cost AS seeded, seq_distance(a, b) AS d, size(seq_search('N', a)) AS places FROM {p}", p=p
    )


@query("sql_affine_functions", f"WITH RECURSIVE {_model_sql(cost_model.affine(1, 2, 1))} SELECT id, (list_extract(m, length(b) + 1))::INT AS cost, (list_extract(m, length(b) + 1))::INT AS aligned, NULL::INT AS nothing FROM g WHERE i = length(a)")
def sql_affine_functions(p: DataFrame) -> DataFrame:
    A.register(p.sparkSession)
    return p.sparkSession.sql("SELECT id, seq_affine_cost(a, b) AS cost, seq_model_align(a, b, 'affine(1,2,1)').cost AS aligned, seq_model_cost(a, cast(NULL AS STRING), 'affine(1,2,1)') AS nothing FROM {p}", p=p)


@query("pairs_through_source", "SELECT a, b, count(*) AS n FROM p GROUP BY 1, 2")
def pairs_through_source(p: DataFrame) -> DataFrame:
    """Written and read by the data source, in parts smaller than a file."""
    datasource.register(p.sparkSession)
    path = f"{shared_dir(p.sparkSession).rstrip('/')}/pairs-{uuid.uuid4()}"
    p.select("a", "b").write.format("seqpairs").mode("append").save(path)
    return _counted(p.sparkSession.read.format("seqpairs").option("splitBytes", 100_000).load(path), path, "a", "b")


_GENERATED_SQL = "SELECT c_custkey::BIGINT AS id, [0, 1, 20, 65, 257][1 + c_custkey % 5] AS n, [0.0::DOUBLE, 0.05::DOUBLE, 1.0::DOUBLE][1 + c_custkey % 3] AS error_rate, ['uniform', 'noisy_insert', 'noisy_delete', 'symmetric_repeat'][1 + c_custkey % 4] AS error_model FROM customer"


@query("generated_grid", f"SELECT n::INT AS n, error_rate, error_model, count(*) AS pairs, sum(n)::BIGINT AS letters, count(*) FILTER (error_rate = 0 OR n = 0) AS equal FROM ({_GENERATED_SQL}) GROUP BY 1, 2, 3", with_pairs=False)
def generated_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs generated with parameters of every customer; without errors b is a, with errors of every letter it isn't."""
    key = F.col("c_custkey")
    one = lambda values, by: F.get(F.array(*map(F.lit, values)), (key % by).cast("int"))
    parameters = spark.read.parquet(f"{sf_dir}/customer.parquet").select(key.cast("bigint").alias("id"), one([0, 1, 20, 65, 257], 5).alias("n"), one([0.0, 0.05, 1.0], 3).alias("error_rate"), one(["uniform", "noisy_insert", "noisy_delete", "symmetric_repeat"], 4).alias("error_model"), F.lit(31415).alias("seed"))
    p = pairs_of(parameters)
    equal = F.when(F.col("error_rate") == 0, F.col("a") == F.col("b")).when(F.col("n") == 0, F.col("b") == "").otherwise(F.lit(False))
    return p.groupBy("n", "error_rate", "error_model").agg(F.count("b").alias("pairs"), F.sum(F.length("a")).cast("bigint").alias("letters"), F.count_if(equal).alias("equal"))


# --- reports and compositions ----------------------------------------------------------------------------------------


@query("error_rate_report", "SELECT id % 5 AS kind, count(*) AS n, avg(length(a)) AS len_a, avg(levenshtein(a, b)) AS cost, avg(100.0 * levenshtein(a, b) / nullif(length(a), 0)) AS error_percent FROM p GROUP BY 1")
def error_rate_report(p: DataFrame) -> DataFrame:
    d = p.select((F.col("id") % 5).alias("kind"), F.length("a").alias("n_a"), expr.distance("a", "b").alias("d"))
    return d.groupBy("kind").agg(F.count("*").alias("n"), F.avg("n_a").alias("len_a"), F.avg("d").alias("cost"), F.avg(F.lit(100.0) * F.col("d") / F.nullif(F.col("n_a"), F.lit(0))).alias("error_percent"))


@query("rollup_error", "SELECT id % 5 AS kind, id % 3 AS edit, count(*) AS n, sum(levenshtein(a, b))::BIGINT AS cost FROM p GROUP BY ROLLUP (1, 2)")
def rollup_error(p: DataFrame) -> DataFrame:
    d = p.select((F.col("id") % 5).alias("kind"), (F.col("id") % 3).alias("edit"), expr.distance("a", "b").alias("d"))
    return d.rollup("kind", "edit").agg(F.count("*").alias("n"), F.sum("d").alias("cost"))


@query("topk_per_segment", "SELECT kind, id, cost FROM (SELECT id % 7 AS kind, id, levenshtein(a, b)::INT AS cost, row_number() OVER (PARTITION BY id % 7 ORDER BY levenshtein(a, b) DESC, id) AS k FROM p) WHERE k <= 10")
def topk_per_segment(p: DataFrame) -> DataFrame:
    d = p.select((F.col("id") % 7).alias("kind"), "id", expr.distance("a", "b").alias("cost"))
    w = Window.partitionBy("kind").orderBy(F.desc("cost"), "id")
    return d.withColumn("k", F.row_number().over(w)).where("k <= 10").drop("k")


@query("window_rank_distance", "SELECT id, cost, dense_rank() OVER (PARTITION BY kind ORDER BY cost)::INT AS rank FROM (SELECT id, id % 100 AS kind, levenshtein(a, b)::INT AS cost FROM p)")
def window_rank_distance(p: DataFrame) -> DataFrame:
    d = p.select("id", (F.col("id") % 100).alias("kind"), expr.distance("a", "b").alias("cost"))
    return d.select("id", "cost", F.dense_rank().over(Window.partitionBy("kind").orderBy("cost")).alias("rank"))


@query("segment_distance", f"WITH p AS ({PAIRS_SQL}) SELECT c_mktsegment AS segment, count(*) AS n, sum(levenshtein(a, b))::BIGINT AS cost FROM p JOIN orders ON id = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1", with_pairs=False)
def segment_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("c_custkey"))
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    d = pairs(spark, sf_dir).select("id", expr.distance("a", "b").alias("d"))
    return d.join(orders, "id").join(customer, "c_custkey").groupBy("segment").agg(F.count("*").alias("n"), F.sum("d").alias("cost"))

