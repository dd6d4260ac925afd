"""Text-side queries: tokenizer, postings, ranked match and the search route."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelake.operators import search as se
from pricelake.plans.oracle import with_views as V
from pricelake.plans.registry import query
from pricelake.plans.stored import stored
from pricelake.sources import fixtures as fx
from pricelake.sources.tables import read_table

TOK_SQL = r"regexp_extract_all(lower({col}), '[\p{{L}}\p{{N}}]+')"
DBL = "CAST({} AS DOUBLE)"


def _post_sql(src: str, id_col: str, text_col: str) -> str:
    tok = TOK_SQL.format(col=text_col)
    return (f"post AS (SELECT doc_id, unnest(toks) AS token, unnest(range(1, len(toks) + 1)) AS pos"
            f" FROM (SELECT {id_col} AS doc_id, {tok} AS toks FROM {src}))")


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def ranked_sql(q: se.TextQuery) -> str:
    """CTEs ``tp``, ``docs``, ``ranked(doc_id, rank)`` over a ``post`` CTE."""
    terms = q.terms()
    pos_terms = q.positive_terms()
    inl = ", ".join(_lit(t) for t in terms)
    w = DBL.format("0.1")
    cols = [f"bool_or(token = {_lit(t)}) AS h{i}" for i, t in enumerate(terms)]
    idx = {t: i for i, t in enumerate(terms)}
    if not q.and_form():
        for t in pos_terms:
            s = (f"list_sum(list_transform(range(1, n + 1), lambda j: {DBL.format('1')} / "
                 f"CAST(j * j AS DOUBLE)))")
            cols.append(f"coalesce(sum(CASE WHEN token = {_lit(t)} THEN {w} * {s} / 1.64493406685"
                        f" END), 0) AS c{idx[t]}")
    cond = ["TRUE"]
    cond += [f"h{idx[t]}" for t in q.all_of + q.phrase]
    if q.any_of:
        cond.append("(" + " OR ".join(f"h{idx[t]}" for t in q.any_of) + ")")
    cond += [f"NOT h{idx[t]}" for t in q.none_of]
    if len(q.phrase) >= 2:
        joins = " ".join(f"JOIN post p{i} ON p{i}.doc_id = p0.doc_id AND p{i}.pos = p0.pos + {i}"
                         f" AND p{i}.token = {_lit(t)}" for i, t in enumerate(q.phrase) if i > 0)
        cond.append(f"EXISTS (SELECT 1 FROM post p0 {joins} WHERE p0.doc_id = docs.doc_id"
                    f" AND p0.token = {_lit(q.phrase[0])})")
    out = (f"tp AS (SELECT doc_id, token, count(*) AS n FROM post WHERE token IN ({inl})"
           f" GROUP BY doc_id, token),\n"
           f"docs AS (SELECT doc_id, {', '.join(cols)} FROM tp GROUP BY doc_id)")
    if q.and_form():
        wd = ("CASE WHEN d > 100 THEN 1e-30 ELSE " + DBL.format("1") +
              " / (1.005 + 0.05 * exp(d / 1.5 - 2)) END")
        pairs = []
        ts = pos_terms
        for i in range(len(ts)):
            for k in range(i):
                pairs.append(
                    f"SELECT a.doc_id, CAST(abs(a.pos - b.pos) AS DOUBLE) AS d FROM post a JOIN post b"
                    f" ON a.doc_id = b.doc_id WHERE a.token = {_lit(ts[i])} AND b.token = {_lit(ts[k])}")
        out += (",\npairs AS (" + " UNION ALL ".join(pairs) + "),\n"
                f"prods AS (SELECT doc_id, product(1 - sqrt({w} * {w} * ({wd}))) AS pr"
                f" FROM pairs GROUP BY doc_id),\n"
                f"ranked AS (SELECT docs.doc_id, round(1 - prods.pr, 9) AS rank FROM docs"
                f" JOIN prods USING (doc_id) WHERE {' AND '.join(cond)})")
    else:
        acc = " + ".join(f"c{idx[t]}" for t in pos_terms) or "0"
        out += (f",\nranked AS (SELECT doc_id, round(({acc}) / {max(len(pos_terms), 1)}, 9) AS rank"
                f" FROM docs WHERE {' AND '.join(cond)})")
    return out


def search_sql(q: se.TextQuery | None, category: str = "", brand: str = "",
               min_price: int | None = None, max_price: int | None = None, sort: str = "",
               limit: int = 20, offset: int = 0, cap: int | None = 1000) -> str:
    """Offers are summed up per product first; hits are numbered by windows."""
    match = "SELECT id AS doc_id, 0 AS rank FROM products"
    ctes = V("obs", "offers", "products")
    if q is not None and q.excludes_only():
        ctes += ",\n" + _post_sql("products", "id", "title")
        words = ", ".join(map(_lit, q.none_of))
        match += f" WHERE id NOT IN (SELECT doc_id FROM post WHERE token IN ({words}))"
    elif q is not None and not q.empty():
        ctes += ",\n" + _post_sql("products", "id", "title") + ",\n" + ranked_sql(q)
        match = "SELECT doc_id, rank FROM ranked"
    keep = [f"{c} = {_lit(v)}" for c, v in (("category", category), ("brand", brand)) if v]
    band = [f"best >= {min_price}"] * (min_price is not None) + [f"best <= {max_price}"] * (max_price is not None)
    by = {"price_asc": "best_price_cents, id", "price_desc": "best_price_cents DESC, id"}.get(sort, "id")
    page = f" ORDER BY {by} LIMIT {limit} OFFSET {offset}" if cap else ""
    return ctes + f""",
priced AS (
  SELECT product_id, min(CASE WHEN in_stock THEN price_cents END) AS best, count(*) AS n_offers
  FROM offers GROUP BY product_id),
numbered AS (
  SELECT m.doc_id, row_number() OVER (ORDER BY m.rank DESC, m.doc_id) AS place
  FROM ({match}) m JOIN products ON id = m.doc_id WHERE {' AND '.join(['true', *keep])}),
hits AS (SELECT doc_id, max(place) OVER () AS found FROM numbered{f' WHERE place <= {cap}' if cap else ''})
SELECT p.id, p.title, p.brand, p.category, best AS best_price_cents, n_offers AS offer_count,
       found AS hit_count, {f'found = {cap}' if cap else 'false'} AS truncated
FROM hits JOIN products p ON p.id = doc_id JOIN priced ON product_id = doc_id
WHERE {' AND '.join(['best IS NOT NULL', *band])}{page}"""


def _postings(spark, sf_dir, name: str, docs, id_col: str, text_col: str):
    """The stored postings of a text column, range-partitioned and sorted by token; a search reads the row
    groups of its terms."""
    path = stored(spark, sf_dir, name, lambda p: se.write_postings(se.postings(docs, id_col, text_col), p))
    return spark.read.parquet(path)


def _title_postings(spark, sf_dir):
    return _postings(spark, sf_dir, "title-postings", fx.products(spark, sf_dir), "id", "title")


def _register_search(name: str, q: se.TextQuery | None, **kw):
    @query(name, search_sql(q, **kw))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return se.search(fx.products(spark, sf_dir), fx.offers(spark, sf_dir),
                         _title_postings(spark, sf_dir) if q else None, q, **kw)
    return run


# Each search exercises a different clause, ranking form, filter or ordering.
_register_search("search", se.TextQuery(all_of=["ring"]))
_register_search("search_broad_capped", se.TextQuery(all_of=["brand"]), sort="price_asc",
                 min_price=1000, limit=100, offset=20)
_register_search("search_all_of", se.TextQuery(all_of=["hot", "plate"]), sort="price_desc",
                 limit=100)
_register_search("search_any_none", se.TextQuery(any_of=["ring", "widget"], none_of=["red"]),
                 category="ECONOMY", limit=100)
_register_search("search_phrase", se.TextQuery(phrase=["small", "widget"]), limit=100)
_register_search("search_terms_any_case", se.TextQuery(all_of=["Red", "RING"]), limit=100)
_register_search("search_excludes_only", se.TextQuery(none_of=["red", "ring"]), limit=100, category="ECONOMY")
_register_search("search_uncapped", se.TextQuery(any_of=["brand", "plate"]), cap=None)
_register_search("search_filters_only", None, category="PROMO", brand="Brand#17",
                 max_price=50000, limit=100)


@query("title_tokens", V("products") + """,
""" + _post_sql("products", "id", "title") + """
SELECT doc_id AS id, pos, token FROM post""")
def q_title_tokens(spark, sf_dir):
    """G1 over product titles: one row per (product, position, token)."""
    p = _title_postings(spark, sf_dir)
    return p.select(F.col("doc_id").alias("id"), "pos", "token")


@query("document_postings", "WITH " + _post_sql("documents", "doc_id", "text") + """
SELECT token, count(DISTINCT doc_id) AS df, count(*) AS tf, min(pos) AS first_pos FROM post
GROUP BY token""")
def q_document_postings(spark, sf_dir):
    """G5 over the whole documents corpus: per token the document frequency, total term
    frequency and earliest position."""
    p = se.postings(read_table(spark, sf_dir, "documents"), "doc_id", "text")
    per_doc = p.groupBy("token", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("p"))
    return per_doc.groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.sum("n").alias("tf"),
                                        F.min("p").alias("first_pos"))


DOC_QUERY = se.TextQuery(all_of=["eau", "le"])


@query("document_rank", "WITH " + _post_sql("documents", "doc_id", "text") + ",\n"
       + ranked_sql(DOC_QUERY) + """
SELECT doc_id, rank FROM ranked ORDER BY rank DESC, doc_id LIMIT 1000""")
def q_document_rank(spark, sf_dir):
    """G2–G4 over the documents corpus: top 1,000 documents containing both terms, by the AND
    rank."""
    p = _postings(spark, sf_dir, "document-postings", read_table(spark, sf_dir, "documents"), "doc_id", "text")
    r = se.match_and_rank(p, DOC_QUERY)
    return r.orderBy(F.col("rank").desc(), "doc_id").limit(1000)
