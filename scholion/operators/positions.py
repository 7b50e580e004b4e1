"""Positional postings: rank by how near a query's words stand to each other, and phrases.

A posting holds the places of a term in a chunk, as gaps: the first place, then the distance to each
next one. Places count all words, stop words too, so a phrase's inner stop words keep their room. Which
chunks hold all terms is decided as in any keyword search; places are joined to those chunks alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholion.functions.stemming import stem
from scholion.functions.text import BETWEEN, LEXEME, STOP_WORDS, fold, singular_word
from scholion.operators.asked import Asked, ask
from scholion.operators.keyword import keyword_matches, term_bucket, with_term_bucket
from scholion.operators.vocabulary import stemmed
from scholion.session import dealt_by, persist_shared, small_side

# The weight of a plain word, the farthest pair that counts, and the damping of distance.
WEIGHT, FARTHEST = 0.1, 100
BASE, SLOPE, SCALE, SHIFT = 1.005, 0.05, 1.5, 2.0
SQUARES = 1.64493406685
RANK_DECIMALS = 9
IDS = ["chunk_id", "document_id"]


def _placed(rows: DataFrame, text: str, keys: list[str], conf: str) -> DataFrame:
    """keys, pos, term: one row for each kept word, places counted from 0 over all words."""
    tokens = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(LEXEME), F.lit(0))
    out = rows.select(*keys, F.posexplode_outer(tokens).alias("pos", "term")).where(F.col("term").isNotNull())
    return out if conf == "simple" else out.where(~F.col("term").isin(STOP_WORDS))


def _folded(rows: DataFrame, conf: str) -> DataFrame:
    return stemmed(rows) if conf == "stem" else rows.withColumn("term", fold(F.col("term"), conf))


def to_gaps(places: Column) -> Column:
    """Sorted places as the first one and the distance to each next one."""
    return F.transform(
        places, lambda p, i: p - F.when(i > 0, F.get(places, (i - 1).cast("int"))).otherwise(0)
    )


def from_gaps(gaps: Column) -> Column:
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("places"))
    step = lambda s, g: F.struct(
        (s["at"] + g).alias("at"), F.concat(s["places"], F.array(s["at"] + g)).alias("places")
    )
    return F.aggregate(gaps, start, step)["places"]


def _posted(conf: str, marked: bool):
    """The postings of one part's texts, whose words stand apart by one blank."""
    folded = {"stem": stem, "english": singular_word}.get(conf, lambda word: word)
    dropped = {""} if conf == "simple" else {"", *STOP_WORDS}

    def run(part: pa.Table) -> pa.Table:
        ids = [part.column(c).combine_chunks() for c in IDS]
        first, second = (i.dictionary_encode("encode").indices.to_numpy() for i in ids)
        # Rows of one chunk count as one, wherever they stand.
        _, at, chunk = np.unique(first * (int(second.max()) + 1) + second, return_index=True, return_inverse=True)
        n_chunks = len(at)
        lists = pc.split_pattern(part.column("words"), " ").chunks
        sizes = np.concatenate([np.diff(x.offsets) for x in lists]).astype(np.int64)
        words = pa.chunked_array([x.flatten() for x in lists]).dictionary_encode().unify_dictionaries().chunks
        distinct = [None if w in dropped else folded(w) for w in words[0].dictionary.to_pylist()]
        terms = list({t for t in distinct if t is not None})
        number = {t: i for i, t in enumerate(terms)}
        of_word = np.array([-1 if t is None else number[t] for t in distinct], dtype=np.int64)
        term = of_word[np.concatenate([x.indices.to_numpy() for x in words])]
        held = term >= 0
        pos = (np.arange(len(term)) - np.repeat(np.cumsum(sizes) - sizes, sizes))[held]
        owner = np.repeat(chunk, sizes)[held]
        length = np.bincount(owner, minlength=n_chunks)
        key = term[held] * n_chunks + owner
        bits = int(pos.max(initial=0)).bit_length()
        if (len(terms) * n_chunks) << bits < 2**63:
            both = np.sort((key << bits) | pos)
            key, pos = both >> bits, both & ((1 << bits) - 1)
        else:
            order = np.lexsort((pos, key))
            key, pos = key[order], pos[order]
        begin = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
        gaps = np.diff(pos, prepend=0)
        gaps[begin] = pos[begin]
        term, owner = np.divmod(key[begin], n_chunks)
        ends = np.append(begin, len(pos))
        if marked:
            term = np.append(term, np.full(n_chunks, len(terms)))
            owner = np.append(owner, np.arange(n_chunks))
            ends = np.append(ends, np.full(n_chunks, len(pos)))
        return pa.table(
            {
                "term": pa.array([*terms, ""], pa.string()).take(pa.array(term)),
                **{c: i.take(pa.array(at[owner])) for c, i in zip(IDS, ids, strict=True)},
                "tf": pa.array(np.diff(ends)),
                "dl": pa.array(length[owner]),
                "gaps": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(gaps, pa.int32())),
            }
        )

    return run


def positional_postings(
    chunks: DataFrame, conf: str = "stem", text_col: str = "content", marked: bool = False
) -> DataFrame:
    """term, chunk_id, document_id, tf, dl, gaps. dl counts the kept words of the chunk.

    Texts are dealt by chunk, so places are put together where they were found: neither words nor places
    are shuffled. A part's words are numbered, and numbers are sorted in place of words. Chunks of one id
    count as one. Null and empty texts have no postings; marked gives each chunk, these too, one more row
    with an empty term and its length.
    """
    if conf not in ("simple", "stop", "english", "stem"):
        raise ValueError(f"unknown text configuration {conf!r}")
    texts = dealt_by(chunks.select(*IDS, text_col), "chunk_id", text_col)
    words = F.btrim(F.regexp_replace(F.lower(F.coalesce(F.col(text_col), F.lit(""))), BETWEEN, " "))
    fields = {f.name: f.dataType for f in chunks.schema.fields}
    schema = T.StructType([T.StructField("term", T.StringType()), *[T.StructField(c, fields[c]) for c in IDS]])
    schema.add("tf", T.LongType()).add("dl", T.LongType()).add("gaps", T.ArrayType(T.IntegerType()))
    return texts.select("_part", *IDS, words.alias("words")).groupBy("_part").applyInArrow(_posted(conf, marked), schema)


def chunk_lengths(postings: DataFrame, chunks: DataFrame, marked: bool = False) -> DataFrame:
    """chunk_id, document_id, dl of every chunk, those without a word included; reads no text.

    Of marked postings only the rows of the chunks themselves are read.
    """
    if marked:
        postings = postings.where(F.col("term") == "")
        if "term_bucket" in postings.columns:
            postings = postings.where(F.col("term_bucket") == term_bucket(F.lit("")))
    known = postings.groupBy("chunk_id").agg(F.max("dl").alias("dl"))
    return chunks.select("chunk_id", "document_id").join(known, "chunk_id", "left").na.fill(0, ["dl"])


def query_places(queries: DataFrame, conf: str = "stem") -> DataFrame:
    """query_id, term, offsets: the places of each term in the query's own text."""
    found = _folded(_placed(queries, "query_text", ["query_id"], conf), conf)
    return found.groupBy("query_id", "term").agg(F.array_sort(F.collect_list("pos")).alias("offsets"))


def placed_matches(
    queries: DataFrame | Asked, chunks: DataFrame, docs: DataFrame, postings: DataFrame, conf: str = "stem",
    lengths: DataFrame | None = None,
) -> DataFrame:
    """query_id, chunk_id, document_id, terms of every chunk that holds all of a query's terms.

    terms is an array of (offsets in the query, places in the chunk). What the queries' terms have of the
    postings is stored, and so are the matches; only matched chunks' places are looked up, by term and chunk.
    """
    asked = ask(queries)
    lengths = chunk_lengths(postings, chunks) if lengths is None else lengths
    wanted = query_places(asked.queries, conf)
    on, asked_for = ["term", "chunk_id"], wanted.select("term").distinct()
    if "term_bucket" in postings.columns:
        asked_for, on = with_term_bucket(asked_for), ["term_bucket", *on]
    # The postings are read once: what is stored of them is what the words that are asked for have.
    asked_of = persist_shared(postings.join(asked.hint(asked_for), asked_for.columns, "left_semi"), "asked")
    matches = persist_shared(
        keyword_matches(
            asked, chunks, docs, conf=conf, postings=asked_of.drop("gaps"), lengths=lengths
        ).select("query_id", "chunk_id", "document_id"),
        "matches",
    )
    keyed = matches.join(asked.hint(wanted), "query_id")
    if "term_bucket" in on:
        keyed = with_term_bucket(keyed)
    # Only places of chunks that match go into the join's shuffle.
    matched = small_side(matches.select("chunk_id").distinct())
    held = asked_of.select(*on, "gaps").join(matched, "chunk_id", "left_semi")
    return (
        keyed.join(held, on)
        .groupBy("query_id", "chunk_id", "document_id")
        .agg(F.array_sort(F.collect_list(F.struct("offsets", from_gaps(F.col("gaps")).alias("places")))).alias("terms"))
    )


def ranked_by_distance(placed: DataFrame) -> DataFrame:
    """query_id, chunk_id, document_id, keyword_score (rounded), as keyword_topk takes them.

    For several terms the score is 1 minus the product of (1 - w) over all pairs of places of different
    terms at most FARTHEST apart, where w = WEIGHT * sqrt(1 / (BASE + SLOPE * exp(distance / SCALE - SHIFT))).
    For a single one it is WEIGHT times the sum of 1 / n^2 over its n places, by the limit of that sum.
    Each place meets at most the FARTHEST next ones, so the work grows with the number of places.
    """
    spots = lambda t, i: F.transform(t["places"], lambda p: F.struct(p.alias("p"), i.alias("t")))
    marked = placed.withColumn("marked", F.array_sort(F.flatten(F.transform("terms", spots))))

    def met(x: Column, i: Column) -> Column:
        later = F.filter(
            F.slice("marked", i + 2, F.lit(FARTHEST)),
            lambda y: (y["p"] - x["p"] <= FARTHEST) & (y["t"] != x["t"]),
        )
        damp = lambda y: BASE + SLOPE * F.exp((y["p"] - x["p"]) / SCALE - SHIFT)
        return F.aggregate(later, F.lit(0.0), lambda a, y: a + F.ln(1 - WEIGHT * F.sqrt(1 / damp(y))))

    paired = 1 - F.exp(F.aggregate(F.transform("marked", met), F.lit(0.0), lambda a, x: a + x))
    alone = F.aggregate(F.sequence(F.lit(1), F.size("marked")), F.lit(0.0), lambda a, k: a + 1.0 / (k * k))
    score = F.when(F.size("terms") > 1, paired).otherwise(WEIGHT * alone / SQUARES)
    return marked.select(
        "query_id", "chunk_id", "document_id", F.round(score, RANK_DECIMALS).alias("keyword_score")
    )


def phrases(placed: DataFrame) -> DataFrame:
    """query_id, chunk_id, document_id, first, times: where a query stands word for word, and how often.

    A term at offset o of the query and place p of the chunk lets the phrase start at p - o; the phrase
    stands where all terms at all offsets agree. Stop words only keep their room.
    """
    each = F.flatten(
        F.transform(
            "terms",
            lambda t: F.transform(t["offsets"], lambda o: F.transform(t["places"], lambda p: p - o)),
        )
    )
    common = F.aggregate(each, F.get(each, F.lit(0)), lambda a, b: F.array_intersect(a, b))
    return (
        placed.withColumn("starts", common)
        .where(F.size("starts") > 0)
        .select("query_id", "chunk_id", "document_id", F.array_min("starts").alias("first"), F.size("starts").alias("times"))
    )
