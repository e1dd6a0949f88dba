"""Many substring searches in one pass over the texts, by an Aho-Corasick automaton of the search table."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusq.registry import query, table
from corpusq.sources.tables import kept


def search_hits(docs: DataFrame, searches: DataFrame, columns: tuple[str, ...] = ("text",), key: str = "doc_id", keep: tuple[str, ...] = (), block_chars: int = 8 << 20) -> DataFrame:
    """Which of ``searches(name, q)`` are contained in which of the text ``columns``: (name, key, a flag ``in_<column>`` each, keep).

    The automaton of all searches runs once over each text, so the cost is that of the texts and the hits, not texts times
    searches. The searches are measured first and sent out in blocks of about ``block_chars`` characters, one pass each;
    a block is the only thing that is held. An empty search is in every text that is not null; null searches and
    texts have no hits; a name with several searches is hit by any of them.
    """
    if not set(docs.columns) >= {key, *columns, *keep}:
        raise ValueError("columns are missing")
    asked = kept(searches.where("name is not null and q is not null").select(F.col("name").cast("string").alias("name"), "q").distinct(), "searches")
    blocks = max(1, -(-(asked.agg(F.sum(F.length("q") + F.length("name") + 16)).first()[0] or 0) // block_chars))
    rows = docs.select(F.col(key).alias("_key"), *(F.col(c).alias(f"_t{i}") for i, c in enumerate(columns)), *(F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    others = ["_key", *(f"_k{i}" for i in range(len(keep)))]
    schema = ", ".join(["_name string", *(f"`{c}` {kinds[c]}" for c in others), *(f"_in{i} boolean" for i in range(len(columns)))])

    def one_pass(words: list[tuple[str, str]]) -> DataFrame:
        sent = docs.sparkSession.sparkContext.broadcast(words)

        def run(batches):
            import ahocorasick

            tree, every = ahocorasick.Automaton(), []
            for name, q in sent.value:
                if q:
                    tree.get(q, None) is None and tree.add_word(q, [])
                    tree.get(q).append(name)
                else:
                    every.append(name)
            tree.make_automaton()

            def hits(t):
                found = set(every)
                if len(tree):
                    for names in {id(x): x for _, x in tree.iter(t)}.values():
                        found.update(names)
                return found

            for b in batches:
                at, names, flags = [], [], []
                texts = [b[f"_t{i}"].tolist() for i in range(len(columns))]
                for row in range(len(b)):
                    own = [hits(t[row]) if isinstance(t[row], str) else () for t in texts]
                    for name in set().union(*own):
                        at.append(row)
                        names.append(name)
                        flags.append([name in o for o in own])
                out = b[others].iloc[at].reset_index(drop=True)
                out.insert(0, "_name", pd.Series(names, dtype=object))
                for i in range(len(columns)):
                    out[f"_in{i}"] = pd.Series([f[i] for f in flags], dtype=bool)
                yield out

        return rows.mapInPandas(run, schema)

    block = F.pmod(F.xxhash64("name"), F.lit(blocks))
    passes = [one_pass([tuple(r) for r in asked.where(block == i).collect()]) for i in range(blocks)]
    found = reduce(DataFrame.unionByName, passes)
    return found.select(F.col("_name").alias("name"), F.col("_key").alias(key), *(F.col(f"_in{i}").alias(f"in_{c}") for i, c in enumerate(columns)), *(F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)))


def title_text_searches(df: DataFrame, searches: DataFrame, title: str, text: str, key: str) -> DataFrame:
    """Rows whose title or text holds a search in any case: (name, key, in_title, in_text), for a whole table of searches."""
    low = df.select(key, F.lower(title).alias("title"), F.lower(text).alias("text"))
    return search_hits(low, searches.select("name", F.lower("q").alias("q")), ("title", "text"), key)


def _phrases(spark, sf_dir) -> DataFrame:
    """Every word pair of the benchmark as a search, named by itself."""
    words = F.split("text", r"[^\p{L}\p{N}]+")
    pairs = F.explode(F.transform(F.sequence(F.lit(2), F.size("w")), lambda i: F.concat_ws(" ", F.element_at("w", (i - 1).cast("int")), F.element_at("w", i.cast("int")))))
    rows = table(spark, sf_dir, "benchmark", "text").select(words.alias("w")).where("size(w) > 1").select(pairs.alias("q")).distinct()
    return rows.select(F.col("q").alias("name"), "q")


@query(r"""WITH w AS (SELECT string_split_regex(text, '[^\p{L}\p{N}]+') AS w FROM benchmark), q AS (SELECT DISTINCT unnest(list_transform(range(2, len(w) + 1), lambda i: w[i - 1] || ' ' || w[i])) AS q FROM w WHERE len(w) > 1)
SELECT q AS name, count(*) AS documents_found, min(doc_id) AS first_id FROM q JOIN documents ON contains(text, q) GROUP BY q""")
def many_searches_documents(spark, sf_dir):
    hits = search_hits(table(spark, sf_dir, "documents", "doc_id", "text"), _phrases(spark, sf_dir))
    return hits.groupBy("name").agg(F.count(F.lit(1)).alias("documents_found"), F.min("doc_id").alias("first_id"))


@query("""WITH q AS (SELECT DISTINCT lower(regexp_extract(url, '^[a-z]+://([^/?#.]*)', 1)) AS name FROM pages)
SELECT name, page_id, contains(lower(url), name) AS in_title, contains(lower(html), name) AS in_text FROM q JOIN pages ON contains(lower(url), name) OR contains(lower(html), name)""")
def title_text_searches_pages(spark, sf_dir):
    """Every first host label as a search, in url and page."""
    p = table(spark, sf_dir, "pages", "page_id", "url", "html")
    q = p.select(F.lower(F.regexp_extract("url", r"^[a-z]+://([^/?#.]*)", 1)).alias("name")).distinct()
    return title_text_searches(p, q.withColumn("q", F.col("name")), "url", "html", "page_id")
