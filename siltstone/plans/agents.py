"""Multi-hop answering, comparative questions, reports, layered triple extraction, and their small parts as queries."""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions import parsing
from siltstone.functions import providers as P
from siltstone.functions import text as T
from siltstone.operators import chunks as C
from siltstone.operators import graph as G
from siltstone.operators import matching as M
from siltstone.operators import multihop as H
from siltstone.operators import postings as I
from siltstone.operators import search as S

from .catalog import query, table


class TokenBucket:
    """Lets so many units a minute pass; wait(n) sleeps until n are there. For clients inside batch functions."""

    def __init__(self, per_minute: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.rate, self.most, self.clock, self.sleep = per_minute / 60, per_minute, clock, sleep
        self.left, self.at = per_minute, clock()

    def wait(self, n: float = 1) -> None:
        while True:
            now = self.clock()
            self.left, self.at = min(self.most, self.left + (now - self.at) * self.rate), now
            if self.left >= min(n, self.most):
                self.left -= n
                return
            self.sleep((min(n, self.most) - self.left) / self.rate)


def with_retries(call: Callable[[], object], attempts: int = 5, pause: float = 1.0, sleep: Callable[[float], None] = time.sleep):
    """call(), again after growing pauses; the last failure is raised."""
    for i in range(attempts):
        try:
            return call()
        except Exception:
            if i == attempts - 1:
                raise
            sleep(pause * 2**i)


def comparative(questions: DataFrame, names: list[str], answer: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """question_id, answers (array<struct(name, answer)>): each question (question_id, text) asked anew about each name in it.

    answer takes (question_id, name, text) and adds answer.
    """
    split = questions.select("question_id", F.explode(parsing.names_in(F.col("text"), names)).alias("name"), "text")
    asked = answer(split.withColumn("text", F.concat_ws(" ", F.lit("About"), "name", F.lit(":"), "text")))
    return asked.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("name", "answer"))).alias("answers"))


def layered_triples(corpus: DataFrame, seeds: DataFrame, extract: Callable[[DataFrame], DataFrame], layers: int) -> DataFrame:
    """head, relation, tail, layer: entities matched in the corpus (key, text), triples extracted for them, their tails the next seeds.

    extract takes (key, text, entry) and gives head, relation, tail. Entities aren't taken up twice.
    """
    spark = corpus.sparkSession
    seen, now, out = seeds.select(F.lower("entry").alias("entry")).distinct(), seeds, None
    for layer in range(layers):
        matched = M.match_dictionary(corpus, "key", "text", now, "entry").select("key", "entry").join(corpus, "key")
        found = G.settled(extract(matched).filter("head <> tail").distinct().withColumn("layer", F.lit(layer)), "triples")
        out = found if out is None else out.unionByName(found)
        now = G.settled(found.select(F.lower("tail").alias("entry")).distinct().join(seen, "entry", "left_anti"), "seeds")
        if now.isEmpty():
            break
        seen = G.settled(seen.unionByName(now), "seen")
    return out if out is not None else spark.createDataFrame([], "head string, relation string, tail string, layer int")


def report(title: str, sections: DataFrame, model: P.Model = P.ExtractiveModel()) -> str:
    """A Markdown report of sections (pos, title, block): a draft a section in parallel, put together in order on the driver."""
    drafts = sections.groupBy("pos", "title").agg(F.array_join(F.array_sort(F.collect_list("block")), "\n").alias("material"))
    rows = drafts.withColumn("draft", P.answer(F.col("material"), model)).orderBy("pos").collect()  # one row a section
    return "\n\n".join([f"# {title}", *(f"## {r.title}\n\n{r.draft}" for r in rows)])


@query(
    """WITH e AS (SELECT DISTINCT w[1] || ' ' || w[2] AS entry FROM (SELECT list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda x: x <> '') AS w FROM benchmark) WHERE len(w) > 1),
    p AS (SELECT doc_id, string_split(regexp_replace(lower(text), '[^\\p{L}\\p{N}\\p{M}_ ]', ' | ', 'g'), ' ') AS w FROM documents),
    b AS (SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS entry FROM p WHERE len(w) > 1)
    SELECT doc_id, entry, count(*) AS n FROM b JOIN e USING (entry) GROUP BY ALL"""
)
def j20_dictionary_match(spark, d):
    """The first two words of each benchmark passage, looked for in all documents."""
    w = F.array_remove(F.split(F.lower("text"), "[^a-z]+"), "")
    entries = table(spark, d, "benchmark").select(w.alias("w")).filter("size(w) > 1").select(F.concat_ws(" ", F.get("w", F.lit(0)), F.get("w", F.lit(1))).alias("entry"))
    return M.match_dictionary(table(spark, d, "documents"), "doc_id", "text", entries, "entry")


@query("""WITH t AS (SELECT doc_id, unnest(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '')) AS term FROM documents), l AS (SELECT doc_id, count(*) AS length FROM t GROUP BY 1),
    s AS (SELECT count(*) AS n, (SELECT sum(length) FROM l) / count(*) AS mean FROM documents), h AS (SELECT doc_id, term, count(*) AS tf FROM t WHERE term IN ('of', 'haing') GROUP BY ALL), f AS (SELECT term, count(*) AS df FROM h GROUP BY 1)
    SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 4) AS score, 'match' AS stage FROM h JOIN f USING (term) JOIN l USING (doc_id), s GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def r02_multi_match(spark, d):
    return I.multi_match(I.index_of(table(spark, d, "documents"), "doc_id", ["source", "text"]), ["source", "text"], "of haing", 10)


@query("""SELECT doc_id, n FROM (SELECT doc_id, len(list_filter(range(1, len(w)), lambda i: w[i] = f[1] AND w[i + 1] = f[2])) AS n
    FROM (SELECT doc_id, list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '') AS w FROM documents), (SELECT list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '')[2:3] AS f FROM documents WHERE doc_id = 5)) WHERE n > 0""")
def r02_phrase(spark, d):
    """Documents with the second and third word of document 5 in a row."""
    words = table(spark, d, "documents").filter("doc_id = 5").select(T.tokens(F.lower("text"))).first()[0][1:3]
    return I.phrase(I.index_of(table(spark, d, "documents"), "doc_id", ["source", "text"]), "text", " ".join(words))


@query("""WITH t AS (SELECT doc_id, unnest(string_split_regex(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')) AS term FROM documents), p AS (SELECT doc_id, term, count(*) AS tf FROM t WHERE term IN ('the', 'of') GROUP BY ALL),
    f AS (SELECT term, count(*) AS df FROM p GROUP BY 1) SELECT doc_id, round(sum(tf * pow(log10((SELECT count(*) FROM documents) / df), 2)), 6) AS score FROM p JOIN f USING (term) GROUP BY 1 HAVING count(*) = 2 ORDER BY 2 DESC, 1 LIMIT 20""")
def r03_fulltext(spark, d):
    return I.fulltext(I.index_of(table(spark, d, "documents"), "doc_id", ["text"], lower=False), "text", ["the", "of"], 20)


@query("SELECT n_nationkey, [n_name] AS names FROM nation")
def r13_names_in_questions(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    names = [r.n_name for r in n.select("n_name").collect()]  # 25 rows
    return n.select("n_nationkey", parsing.names_in(F.concat(F.lit("What of "), F.lower("n_name"), F.lit("?")), names).alias("names"))


@query("SELECT item_id, '{\"a\": ' || item_id || ', \"b\": \"x\"}' AS j FROM benchmark")
def f10_json_or_pairs(spark, d):
    i = F.col("item_id").cast("string")
    t = F.when(F.col("item_id") % 2 == 0, F.concat(F.lit('so {"a": '), i, F.lit(',\n"b": "x"} and {"c": 1}'))).otherwise(F.concat(F.lit("a: "), i, F.lit(', b: "x"')))
    return table(spark, d, "benchmark").select("item_id", parsing.json_object(t).alias("j"))


@query("SELECT item_id, 'N' || item_id AS entity_name, 'all of it' AS entity_description, 2 AS n FROM benchmark")
def f13_cluster_summary(spark, d):
    t = F.concat(F.lit("Aggregate entity name: N"), "item_id", F.lit("\nDescription: all of it\n1. first: because\n2. second: also"))
    return table(spark, d, "benchmark").select("item_id", parsing.cluster_summary(t).alias("c")).select("item_id", "c.entity_name", "c.entity_description", F.size("c.findings").alias("n"))


_W = "regexp_matches({}, '^[\\p{{L}}\\p{{N}}\\p{{M}}_]$')"


@query(f"SELECT doc_id, NOT {_W.format('substr(text, 5, 1)')} AS a, NOT {_W.format('substr(text, 3, 1)')} AND NOT {_W.format('substr(text, 9, 1)')} AS b FROM documents")
def f16_word_boundary(spark, d):
    """Whether the first four characters of a text, and its fourth to eighth, stand on word boundaries."""
    at = lambda a, b: parsing.on_word_boundary(F.col("text"), F.lit(a), F.lit(b))
    return table(spark, d, "documents").select("doc_id", at(0, 4).alias("a"), at(3, 8).alias("b"))


@query(
    """WITH g AS (SELECT c, r FROM range(1, 13) x(c), range(1, 13) y(r) WHERE c * r <= 12)
    SELECT p_partkey, CAST(first(c * r ORDER BY abs(p_size / 10.0 - c / r), c * r, c, r) AS INT) AS tiles, CAST(first(c ORDER BY abs(p_size / 10.0 - c / r), c * r, c, r) AS INT) AS columns FROM part, g GROUP BY 1"""
)
def f36_tiles(spark, d):
    """Grids for pictures as wide as a part's size and ten high."""
    g = parsing.tile_grid(F.col("p_size"), F.lit(10))
    return table(spark, d, "part").select("p_partkey", F.size(parsing.tile_boxes(g, 448)).alias("tiles"), g["columns"].alias("columns"))


@query("SELECT n_nationkey, 'of  see ' || CASE WHEN n_regionkey IN (1, 2) THEN '[' || n_regionkey || ']' ELSE '' END || ' and [a link](x)' AS text FROM nation")
def f32_citations(spark, d):
    marked = F.concat(F.lit("of ["), "n_name", F.lit("] see [R"), "n_regionkey", F.lit("] and [a link](x)"))
    return table(spark, d, "nation").select("n_nationkey", parsing.rewrite_citations(marked, {"R1": 1, "R2": 2}).alias("text"))


@query("""WITH f AS (SELECT n_nationkey AS k, n_regionkey AS r FROM nation ORDER BY 1 LIMIT 3),
    p AS (SELECT a.k AS a, b.k AS b, a.r AS ra, b.r AS rb FROM f a JOIN f b ON 'n' || a.k < 'n' || b.k),
    e AS (SELECT 'n' || a AS src, 'r' || ra AS tgt, 20 AS s FROM p UNION ALL SELECT 'n' || b, 'r' || rb, 20 FROM p UNION ALL SELECT 'r' || ra, 'root', 15 FROM p WHERE ra <> rb UNION ALL SELECT 'r' || rb, 'root', 15 FROM p WHERE ra <> rb)
    SELECT src, tgt, CAST(sum(s) AS BIGINT) AS score FROM e GROUP BY ALL ORDER BY 3 DESC, 1, 2 LIMIT 10""")
def g07_keyword_graph(spark, d):
    n = table(spark, d, "nation")
    nodes = n.select(F.concat(F.lit("n"), "n_nationkey").alias("node"), F.col("n_name").alias("name"))
    edges = n.select(F.concat(F.lit("n"), "n_nationkey").alias("src"), F.concat(F.lit("r"), "n_regionkey").alias("tgt"))
    edges = edges.unionByName(n.select(F.concat(F.lit("r"), "n_regionkey").alias("src"), F.lit("root").alias("tgt")).distinct())
    first = [r.n_name for r in n.orderBy("n_nationkey").limit(3).collect()]
    return M.keyword_graph_search(edges, nodes, " ".join(first), 10)


@query("SELECT n_name AS head, 'lies in' AS relation, r_name AS tail, CASE WHEN n_regionkey = 1 THEN 0 ELSE 1 END AS layer FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_regionkey = 1 UNION ALL SELECT n_name, 'lies in', r_name, 1 FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_regionkey = 1")
def q11_layered_triples(spark, d):
    corpus = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("key"), F.concat_ws(" ", F.lit("1."), "n_name", F.lit("| lies in |"), "r_name").alias("text"))
    seeds = table(spark, d, "nation").filter("n_regionkey = 1").select(F.col("n_name").alias("entry"))
    extract = lambda m: m.select(F.explode(T.triples(F.col("text"))).alias("t")).select("t.*")
    return layered_triples(corpus, seeds, extract, 3)


@query("SELECT r_regionkey AS question_id, name, 'About ' || name || ' : Compare ' || r_name || ' with ASIA.' AS answer FROM (SELECT r_regionkey, r_name, unnest(list_distinct([r_name, 'ASIA'])) AS name FROM region)")
def q16_comparative(spark, d):
    q = table(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("question_id"), F.concat_ws(" ", F.lit("Compare"), "r_name", F.lit("with ASIA.")).alias("text"))
    names = [r.r_name for r in table(spark, d, "region").collect()]  # 5 rows
    found = comparative(q, names, lambda a: a.withColumn("answer", P.answer(F.col("text"))))
    return found.select("question_id", F.explode("answers").alias("a")).select("question_id", "a.name", "a.answer")


@query()
def c02_header_then_size(spark, d):
    t = F.concat(F.lit("# Title\n"), "text", F.lit("\n## More\n"), "lang")
    parts = C.by_headers(table(spark, d, "documents").select("doc_id", t.alias("t")), "t", "doc_id")
    return C.by_function(parts.withColumn("section", F.col("section").cast("int")), "content", ["doc_id", "section"], partial(C.split_by_size, size=600, overlap=60, stops=C.STOPS["en"]))


@query("SELECT s_suppkey, r_name AS answer, 3 AS hops, 3 AS gathered FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey")
def q19_multi_hop(spark, d):
    """Where each supplier is, told in three hops: supplier to nation, nation to region, region to its name."""
    row = lambda t, text: table(spark, d, t).select(F.concat(*text).alias("text"))
    one = lambda mark, c: F.concat(F.lit(mark), F.col(c).cast("string"))
    texts = row("supplier", [one("s", "s_suppkey"), F.lit(" lies in "), one("n", "s_nationkey")]).unionByName(row("nation", [one("n", "n_nationkey"), F.lit(" belongs to "), one("r", "n_regionkey")]))
    texts = G.settled(texts.unionByName(row("region", [one("r", "r_regionkey"), F.lit(" goes by "), F.col("r_name")])).withColumn("key", F.xxhash64("text")), "texts")
    path = G.shared_path(spark, "texts-index")
    I.build(texts, "key", ["text"], path)
    retrieve = H.text_retriever(I.open_index(spark, "key", path), "text", texts, "text", 4)
    # The critic reads the last note: its end is the next thing to ask about, or the answer after "goes by".
    about = lambda query, texts: F.get(F.filter(texts, lambda t: F.startswith(t, F.concat(F.substring_index(query, " ", 1), F.lit(" ")))), F.lit(0))
    last = lambda memory: F.try_element_at(memory, F.lit(-1))
    end = lambda memory, word: F.when(F.contains(last(memory), F.lit(word)), F.substring_index(last(memory), word, -1))
    asks = lambda memory: F.coalesce(F.concat(end(memory, " lies in "), F.lit(" belongs")), F.concat(end(memory, " belongs to "), F.lit(" goes")))
    critic = lambda question, memory: F.struct(end(memory, " goes by ").alias("answer"), asks(memory).alias("query"))
    questions = table(spark, d, "supplier").select("s_suppkey", one("s", "s_suppkey").alias("question"))
    found = H.answer_questions(questions, retrieve, lambda question, query, texts: about(query, texts), critic, 4)
    return found.select("s_suppkey", "answer", "hops", F.size("memory").alias("gathered"))
