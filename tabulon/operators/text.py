"""Text: extractive summaries, classes, sentiment, entities, embeddings.

Words are rows and every score is a join or an aggregate, so that long documents
and large corpora divide over tasks.  Summaries compare the sentences of one
document only, so they are made row by row from Arrow batches, in memory that does
not grow with the square of a document.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from ..storage import stable

# Stop words by language.
STOP_WORDS = {
    "english": """
        a an and are as at be been being but by can could did do does doing done
        down during each for from further had has have having he her here hers
        herself him himself his how i if in into is it its itself just me more
        most my myself nor not now of off on once only or other our ours ourselves
        out over own s same she should so some such t than that the their theirs
        them themselves then there these they this those through to too under until
        up very was we were what when where which while who whom why will with would
        you your yours yourself yourselves
    """,
    "german": "und oder der die das ein eine ist war sind sein im in an auf für nicht mit von zu dem den des es sie er wir ihr ihnen",
    "french": "et ou le la les un une est était sont être dans sur pour avec de du des à au aux il elle nous vous ils elles ne pas",
    "spanish": "y o el la los las un una es era son ser en sobre para con de del al a él ella nosotros vosotros ellos ellas no",
    "indonesian": "dan atau yang adalah ini itu di ke pada untuk dengan dari dalam tidak akan sudah telah ada saya kamu dia kami mereka",
}
WORD = r"\p{L}+"
#: A sentence ends at closing punctuation before white space and a capital, a digit
#: or an opening mark; in a text without any capital, at punctuation before white space.
BREAK = r"(?<=[.!?\u2026])\s+(?=[\p{Lu}\p{Lt}\p{Nd}\"'(\u00bf\u00a1])"
PLAIN_BREAK = r"(?<=[.!?\u2026])\s+"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)``; a lambda variable holds the value, which is computed once a row."""
    return F.transform(F.array(value), body)[0]


def sentences(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, k, sentence), k from 0."""
    return df.select(F.col(id_col), F.posexplode(_split(text_col)).alias("k", "sentence"))


def _split(text_col: str) -> Column:
    parts = F.when(F.col(text_col).rlike(r"\p{Lu}"), F.split(text_col, BREAK)).otherwise(F.split(text_col, PLAIN_BREAK))
    return F.filter(F.transform(parts, lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")


def words(rows: DataFrame, text_col: str, language: str | None = "english") -> DataFrame:
    """One row a word (column ``w``, place ``i``), without stop words."""
    found = F.regexp_extract_all(F.lower(text_col), F.lit(WORD), 0)
    out = rows.select(*(c for c in rows.columns if c != text_col), F.posexplode(found).alias("i", "w"))
    return out.filter(~F.col("w").isin(STOP_WORDS[language].split())) if language else out


def _whole_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (id, k, …), cut anew before a k of 0, so that none divides a document."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        first = np.flatnonzero(batch.column(1).to_numpy() == 0)
        if len(first):
            at = int(first[-1])
            held.append(batch.slice(0, at))
            if any(b.num_rows for b in held):
                yield pa.concat_batches(held)
            held = [batch.slice(at)]
        else:
            held.append(batch)
    if held:
        yield pa.concat_batches(held)


def _summaries(df: DataFrame, id_col: str, text_col: str, n: int, language: str, pick: Callable, maxlen: int | None = None) -> DataFrame:
    """(id, summary) of every row that has a sentence: ``pick(k, w, at, size, n)``
    gets for each word that is no stop word the number of its sentence, its code and
    its place in the sentence, then the number of sentences and how many to take.
    ``maxlen`` asks for about so many characters, 40 a sentence.  One row never needs
    another, so nothing is shuffled; sentences are sent to Python as rows, so that a
    batch holds so many sentences and not so many documents."""
    n = n if maxlen is None else max(1, round(maxlen / 40))
    stop = STOP_WORDS[language].split()
    found = F.transform(F.regexp_extract_all(F.lower("_s"), F.lit(WORD), 0), lambda w: F.when(w.isin(stop), "").otherwise(w))
    rows = sentences(df, id_col, text_col).select(F.col(id_col), "k", F.col("sentence").alias("_s")).withColumn("_w", found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole_documents(batches):
            sents, toks = batch.column(2), batch.column(3)
            at = np.append(np.flatnonzero(batch.column(1).to_numpy() == 0), batch.num_rows)
            start = toks.offsets.to_numpy()
            flat = toks.values
            code = pc.dictionary_encode(flat).indices.to_numpy()
            real = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
            out = []
            for lo, hi in zip(at, at[1:], strict=False):
                size = int(hi - lo)
                here = start[lo : hi + 1]
                own = real[here[0] : here[-1]]
                k = np.repeat(np.arange(size), np.diff(here))
                place = (np.arange(here[0], here[-1]) - here[k])[own]
                best = range(size) if size <= n else sorted(pick(k[own], code[here[0] : here[-1]][own], place, size, n))
                out.append(" ".join(sents[int(lo + i)].as_py() for i in best))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at[:-1], pa.int64())), pa.array(out, pa.string())], names=[id_col, "summary"])

    kind = StructType([df.select(id_col).schema[0], StructField("summary", StringType())])
    return rows.mapInArrow(run, kind)


def luhn(df: DataFrame, id_col: str, text_col: str, n: int = 3, language: str = "english", least: int = 2, gap: int = 4, maxlen: int | None = None) -> DataFrame:
    """Luhn (1958): significant words occur ``least`` times in the document; a
    sentence scores its best cluster, significant words squared over its span.
    Ties go to the earlier sentence."""

    def pick(k: np.ndarray, w: np.ndarray, at: np.ndarray, size: int, n: int) -> list[int]:
        _, w, count = np.unique(w, return_inverse=True, return_counts=True)
        sig = count[w] >= least
        k, at = k[sig], at[sig]
        score = np.zeros(size)
        if len(k):
            new = np.ones(len(k), bool)
            new[1:] = (k[1:] != k[:-1]) | (at[1:] - at[:-1] > gap)
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(k)) - 1
            many = last - first + 1
            np.maximum.at(score, k[first], many * many / (at[last] - at[first] + 1))
        return np.argsort(-np.round(score, 9), kind="stable")[:n].tolist()

    return _summaries(df, id_col, text_col, n, language, pick, maxlen)


def sumbasic(df: DataFrame, id_col: str, text_col: str, n: int = 3, language: str = "english", maxlen: int | None = None) -> DataFrame:
    """SumBasic (2007): mean word probability; after each pick the probabilities
    of its words are squared.  Ties go to the earlier sentence; sentences without
    words come last."""

    def pick(k: np.ndarray, w: np.ndarray, at: np.ndarray, size: int, n: int) -> list[int]:
        _, w, count = np.unique(w, return_inverse=True, return_counts=True)
        p, long = count / max(len(w), 1), np.bincount(k, minlength=size)
        chosen: list[int] = []
        for _ in range(n):
            score = np.round(np.bincount(k, p[w], size) / np.maximum(long, 1), 12)
            score[long == 0] = -1
            score[chosen] = -2
            chosen.append(int(np.argmax(score)))
            used = np.unique(w[k == chosen[-1]])
            p[used] = p[used] * p[used]
        return chosen

    return _summaries(df, id_col, text_col, n, language, pick, maxlen)


def kl_sum(df: DataFrame, id_col: str, text_col: str, n: int = 3, language: str = "english", maxlen: int | None = None) -> DataFrame:
    """KL-Sum (2009): greedily the sentence that brings the summary's words
    nearest to the document's, by the divergence of document from summary over the
    summary's words.  Ties go to the earlier sentence; sentences without words
    come last."""

    def pick(k: np.ndarray, w: np.ndarray, at: np.ndarray, size: int, n: int) -> list[int]:
        _, w, count = np.unique(w, return_inverse=True, return_counts=True)
        q, long, held = np.log(count / max(len(w), 1)), np.bincount(k, minlength=size), np.zeros(len(count))
        ks, ws, c = _cells(k, w, len(count))
        part = lambda x, q: x * (np.log(np.maximum(x, 1)) - q)
        chosen: list[int] = []
        for _ in range(n):
            # sum p ln(p / q) with p = x / total, where only a sentence's own words change x
            total = held.sum() + long
            change = np.bincount(ks, part(held[ws] + c, q[ws]) - part(held[ws], q[ws]), size)
            kl = np.round((part(held, q).sum() + change) / np.maximum(total, 1) - np.log(np.maximum(total, 1)), 12)
            kl[long == 0] = np.finfo(float).max
            kl[chosen] = np.inf
            chosen.append(int(np.argmin(kl)))
            mine = ks == chosen[-1]
            held[ws[mine]] += c[mine]
        return chosen

    return _summaries(df, id_col, text_col, n, language, pick, maxlen)


def _cells(k: np.ndarray, w: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sentence, word, count) of distinct pairs, in this order."""
    key, c = np.unique(k * np.int64(n_words) + w, return_counts=True)
    return *np.divmod(key, max(n_words, 1)), c


#: Numbers of a similarity matrix held at once; a longer document's matrix is made anew, by strips, in each round.
HELD, STRIP = 1 << 22, 1 << 18


def rank_summary(df: DataFrame, id_col: str, text_col: str, n: int = 3, method: str = "lexrank", language: str = "english", rounds: int = 20, threshold: float = 0.1, damping: float = 0.85, maxlen: int | None = None) -> DataFrame:
    """LexRank (cosine of TF-IDF over ``threshold``) or TextRank (shared words over
    log lengths), 2004: power iteration on the sentence graph of each document."""

    def pick(k: np.ndarray, w: np.ndarray, at: np.ndarray, size: int, n: int) -> list[int]:
        _, w = np.unique(w, return_inverse=True)
        n_words = int(w.max()) + 1 if len(w) else 0
        ks, ws, tf = _cells(k, w, n_words)
        idf = np.log(size / np.bincount(ws, minlength=n_words)) + 1
        # sentences of the same words have the same edges and so the same rank: one node each, that counts often
        cells = np.searchsorted(ks, np.arange(size + 1))
        known: dict[tuple[bytes, bytes], int] = {}
        node = np.array([known.setdefault((ws[i:j].tobytes(), tf[i:j].tobytes()), len(known)) for i, j in zip(cells, cells[1:], strict=False)])
        nodes, often = len(known), np.bincount(node)
        lead = np.zeros(size, bool)
        lead[np.unique(node, return_index=True)[1]] = True
        of = lead[ks]
        ks, ws, tf = node[ks[of]], ws[of], tf[of]
        many = np.bincount(ws, minlength=n_words)
        own = np.bincount(ks, minlength=nodes)
        logs = np.log(np.maximum(own, 1))
        x = np.ones(len(ks))
        if method == "lexrank":
            x = tf * idf[ws]
            x = x / np.sqrt(np.bincount(ks, x * x, nodes))[ks]
        order = np.argsort(ws, kind="stable")  # the sentences of a word lie together
        first = np.cumsum(many) - many
        # a strip has at most STRIP pairs of sentences and pairs by word, or is one sentence
        cells = np.searchsorted(ks, np.arange(nodes + 1))
        work = np.concatenate([[0], np.cumsum(many[ws])])[cells] + np.arange(nodes + 1) * nodes

        def strip(lo: int, hi: int) -> np.ndarray:
            i = np.arange(cells[lo], cells[hi])
            times = many[ws[i]]
            a = np.repeat(i, times)
            b = order[np.arange(len(a)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(first[ws[i]], times)]
            e = np.bincount((ks[a] - lo) * nodes + ks[b], x[a] * x[b], (hi - lo) * nodes).reshape(hi - lo, nodes)
            if method == "lexrank":
                e = (e > threshold).astype(float)
            else:
                both = logs[lo:hi, None] + logs
                e = np.divide(e, both, out=np.zeros(e.shape), where=both > 0)
            others = np.broadcast_to(often, e.shape).copy()
            others[np.arange(hi - lo), np.arange(lo, hi)] -= 1
            return e * others

        cuts = [0]
        while cuts[-1] < nodes:
            cuts.append(max(cuts[-1] + 1, int(np.searchsorted(work, work[cuts[-1]] + STRIP, "right")) - 1))
        strips = list(zip(cuts, cuts[1:], strict=False))
        made = [strip(*s) for s in strips] if nodes * nodes <= HELD else None
        get = lambda j: made[j] if made is not None else strip(*strips[j])
        out = np.concatenate([get(j).sum(axis=1) for j in range(len(strips))])
        share = np.divide(1.0, out, out=np.zeros(nodes), where=out > 0)
        rank = np.ones(nodes)
        for _ in range(rounds):
            flow = rank * share
            rank = (1 - damping) + damping * np.concatenate([get(j) @ flow for j in range(len(strips))])
        return np.argsort(-np.round(rank[node], 9), kind="stable")[:n].tolist()

    return _summaries(df, id_col, text_col, n, language, pick, maxlen)


#: Commonest words whose weights are sent to all tasks, (label, word) rows that may be, and words that a task counts at once.
COMMON_WORDS, MAX_LABEL_WORDS, WORDS_AT_ONCE = 100_000, 1_000_000, 1 << 18


def _cuts(offsets: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Row ranges of at most ``most`` elements, or of one row."""
    cuts = [0]
    while cuts[-1] < len(offsets) - 1:
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(offsets, offsets[cuts[-1]] + most, "right")) - 1))
    return list(zip(cuts, cuts[1:], strict=False))


def _counted(lists: pa.ListArray) -> Iterator[tuple[int, int, pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """For a few rows at a time: their range, the distinct words, and (row in the range, word, count) of the distinct pairs in this order."""
    at = lists.offsets.to_numpy()
    for lo, hi in _cuts(at, WORDS_AT_ONCE):
        coded = pc.dictionary_encode(lists.values.slice(int(at[lo]), int(at[hi] - at[lo])))
        row = np.repeat(np.arange(hi - lo), np.diff(at[lo : hi + 1]))
        yield lo, hi, coded.dictionary, *_cells(row, coded.indices.to_numpy(), len(coded.dictionary))


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, found, _, w, _ in _counted(batch.column(0)):
            yield pa.RecordBatch.from_arrays([found, pa.array(np.bincount(w, minlength=len(found)), pa.int64())], names=["w", "docs"])


def classify(df: DataFrame, id_col: str, text_col: str, labels: DataFrame, threshold: float = 0.0) -> DataFrame:
    """(id, v_class, v_score): the label (label, description) with the greatest
    TF-IDF cosine, the least of equals; none where no word is shared.

    The tasks get the weights of the commonest words and of the labels' words, and
    compare a text with all labels where it is read; the rarer words are joined with
    their weights, which only the text's norm needs.  A text takes the labels along
    that can be its best or equal to it when rounded.  Rows count as documents; rows
    of one id share a score, that of one of them where they are equal, and take all
    labels along.  More than MAX_LABEL_WORDS words of labels are an error.
    """
    words_of = F.regexp_extract_all(F.lower(text_col), F.lit(WORD), 0).alias("ws")
    n = df.count()
    docs = stable(df.select(words_of).mapInArrow(_document_counts, "w string, docs bigint").groupBy("w").agg(F.sum("docs").alias("docs")))
    lab = labels.filter("label IS NOT NULL").select("label", F.explode(F.regexp_extract_all(F.lower("description"), F.lit(WORD), 0)).alias("w")).groupBy("label", "w").agg(F.count("*").alias("tf"))
    if lab.limit(MAX_LABEL_WORDS + 1).count() > MAX_LABEL_WORDS:
        raise ValueError(f"the labels have more than {MAX_LABEL_WORDS} words")
    z = lab.join(docs, "w", "left").select("label", "w", "tf", "docs").orderBy("label", "w").toArrow()  # MAX_LABEL_WORDS rows
    common = docs.orderBy(F.desc("docs"), "w").limit(COMMON_WORDS).toArrow()  # COMMON_WORDS rows
    weight = lambda docs: np.log((1.0 + n) / (1.0 + docs)) + 1

    # a row of ``known`` words each: its weight, and its labels from start[w] to start[w + 1]
    z_docs = pc.fill_null(z["docs"], -1).to_numpy()
    z_idf = np.where(z_docs < 0, 1.0, weight(np.maximum(z_docs, 0)))
    names = pa.array([], z["label"].type) if not len(z) else pc.unique(z["label"].combine_chunks())
    z_label = pc.index_in(z["label"], names).to_numpy().astype(np.int64)
    z_x = z["tf"].to_numpy() * z_idf
    z_x = z_x / np.sqrt(np.bincount(z_label, z_x * z_x, len(names)))[z_label]
    known = pc.unique(pa.concat_arrays([x.cast(pa.string()) for t in (common, z) for x in t["w"].chunks] or [pa.array([], pa.string())]))
    z_w = pc.index_in(z["w"], known).to_numpy().astype(np.int64)
    idf = np.ones(len(known))
    idf[z_w] = z_idf
    idf[pc.index_in(common["w"], known).to_numpy().astype(np.int64)] = weight(common["docs"].to_numpy())
    order = np.argsort(z_w, kind="stable")
    start = np.concatenate([[0], np.cumsum(np.bincount(z_w, minlength=len(known)))])
    z_label, z_x, rarest = z_label[order], z_x[order], float(weight(1))

    best = pa.list_(pa.struct([("label", names.type), ("d", pa.float64())]))
    kind = df.select(id_col).schema[0].dataType
    out = StructType([StructField(id_col, kind), StructField("w", StringType()), StructField("tf", DoubleType()), StructField("sq", DoubleType()), StructField("best", ArrayType(StructType([StructField("label", labels.schema["label"].dataType), StructField("d", DoubleType())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, alone = batch.column(0), batch.column(2).to_numpy(zero_copy_only=False)
            for lo, hi, found, row, w, tf in _counted(batch.column(1)):
                place = pc.fill_null(pc.index_in(found, known), -1).to_numpy()[w]
                rare = place < 0
                x = tf * np.where(rare, rarest, idf[place] if len(idf) else rarest)
                sq = np.bincount(row[~rare], x[~rare] ** 2, hi - lo)
                most = np.sqrt(np.bincount(row, x * x, hi - lo))  # of the text's norm
                cells = np.searchsorted(row, np.arange(hi - lo + 1))
                size, took, score = [], [], []
                there = np.flatnonzero(np.diff(cells))
                for r in there:
                    own = slice(cells[r], cells[r + 1])
                    mine, weights = place[own][~rare[own]], x[own][~rare[own]]
                    many = start[mine + 1] - start[mine]
                    i = np.repeat(start[mine] - np.cumsum(many) + many, many) + np.arange(many.sum())
                    d = np.bincount(z_label[i], np.repeat(weights, many) * z_x[i], len(names))
                    least = d.max(initial=0) * (1 - 1e-12) - 1.1e-9 * most[r] if alone[lo + r] else 0
                    keep = np.flatnonzero((d > 0) & (d >= least))
                    if alone[lo + r]:  # a label that is no better than one before it is never taken
                        keep = keep[d[keep] > np.concatenate([[0], np.maximum.accumulate(d[keep])])[:-1]]
                    size.append(len(keep))
                    took.append(keep)
                    score.append(d[keep])
                if not len(there):
                    continue
                pairs = pa.StructArray.from_arrays([names.take(pa.array(np.concatenate(took))), pa.array(np.concatenate(score))], names=["label", "d"])
                offsets = pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32())
                whole = [ids.take(pa.array(lo + there)), pa.array([str(lo + r) for r in there], pa.string()), pa.nulls(len(there), pa.float64()), pa.array(sq[there]), pa.ListArray.from_arrays(offsets, pairs)]
                part = [ids.take(pa.array(lo + row[rare])), found.take(pa.array(w[rare])), pa.array(tf[rare].astype(float)), pa.nulls(int(rare.sum()), pa.float64()), pa.nulls(int(rare.sum()), best)]
                for arrays in (whole, part):
                    yield pa.RecordBatch.from_arrays(arrays, names=out.names)

    # a text's own row has digits for a word, which no word has: it passes the join as it is
    twice = df.groupBy(id_col).count().filter("count > 1").select(id_col, F.lit(False).alias("alone"))
    rows = df.select(id_col, text_col).withColumn("alone", F.lit(True)) if twice.isEmpty() else df.select(id_col, text_col).join(twice, id_col, "left").fillna(True, ["alone"])
    rows = rows.select(id_col, words_of, "alone").mapInArrow(run, out)
    idf_of = F.ln((1.0 + n) / (1.0 + F.col("docs"))) + 1
    x = rows.join(docs, "w", "left").select(id_col, F.coalesce("sq", (F.col("tf") * idf_of) ** 2).alias("sq"), "best")
    per = x.groupBy(id_col).agg(F.sum("sq").alias("sq"), F.collect_list("best").alias("best"))
    cos = per.select(id_col, F.sqrt(F.col("sq") * F.size("best")).alias("nx"), F.inline(F.flatten("best"))).groupBy(id_col, "nx", "label").agg(F.sum("d").alias("d"))
    score = cos.select(id_col, "label", F.round(F.col("d") / F.col("nx"), 9).alias("score")).filter(F.col("score") >= threshold)
    pick = score.groupBy(id_col).agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("label"))).alias("b"))
    return df.select(id_col).join(pick, id_col, "left").select(id_col, F.col("b.label").alias("v_class"), (-F.col("b.s")).alias("v_score"))


def sentiment(df: DataFrame, id_col: str, text_col: str, lexicon: DataFrame, cut: float = 0.05) -> DataFrame:
    """(id, label, score): the mean score of the lexicon's (word, score) words."""
    w = words(df.select(id_col, text_col), text_col, None)
    got = w.join(lexicon, w["w"] == lexicon["word"]).groupBy(id_col).agg(F.avg("score").alias("score"))
    out = df.select(id_col).join(got, id_col, "left").fillna(0.0, ["score"])
    return out.select(id_col, F.when(F.col("score") > cut, "positive").when(F.col("score") < -cut, "negative").otherwise("neutral").alias("label"), "score")


def entities(df: DataFrame, id_col: str, text_col: str, gazetteer: DataFrame, most_words: int = 3) -> DataFrame:
    """(id, entities, n): "phrase/GROUP, …" in order, by (phrase, group) of up to
    ``most_words`` words, lower case."""
    found = F.regexp_extract_all(F.lower(text_col), F.lit(WORD), 0)

    def grams(w: Column, size: int) -> Column:
        starts = F.when(F.size(w) >= size, F.sequence(F.lit(1), F.size(w) - size + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.struct(i.alias("i"), F.lit(size).alias("n"), F.array_join(F.slice(w, i, size), " ").alias("phrase")))

    all_ = _let(found, lambda w: F.concat(*(grams(w, k) for k in range(1, most_words + 1))))
    rows = df.select(F.col(id_col), F.explode(all_).alias("x")).select(id_col, "x.*")
    hit = rows.join(gazetteer, "phrase").groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("i", "n", "phrase", "group"))).alias("x"))
    text = F.array_join(F.transform("x", lambda e: F.concat(e["phrase"], F.lit("/"), e["group"])), ", ")
    return df.select(id_col).join(hit, id_col, "left").select(id_col, F.coalesce(text, F.lit("")).alias("entities"), F.greatest(F.size("x"), F.lit(0)).cast("bigint").alias("n"))


#: Directions beyond those asked for, and passes that sharpen them.
OVERSAMPLE, PASSES = 10, 4


def _products(rows: Iterator[pa.RecordBatch], idf: np.ndarray, q: np.ndarray) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For batches of (id, hashed words): row numbers, features and TF-IDF weights of
    the distinct words of each row, and the rows times ``q``."""
    for b in rows:
        lists = b.column(1)
        size = np.diff(np.asarray(lists.offsets))
        flat = np.asarray(lists.flatten(), np.int64)
        cells, tf = np.unique(np.repeat(np.arange(len(size)), size) * len(idf) + flat, return_counts=True)
        at, feature = cells // len(idf), cells % len(idf)
        x = tf * idf[feature]
        y = np.stack([np.bincount(at, x * q[feature, j], len(size)) for j in range(q.shape[1])], axis=1)
        yield b, at, feature, x, y


def embed(df: DataFrame, id_col: str, text_col: str, stub: str = "emb", dims: int = 16, features: int = 1024, seed: int = 1) -> DataFrame:
    """stub_1 … stub_N: hashed TF-IDF along its principal directions.

    The directions come from a randomised range finder: a seeded Gaussian sketch of
    the covariance, sharpened by ``PASSES`` passes over the texts, each of which adds
    up a matrix of features x (dims + ``OVERSAMPLE``) only; the last gives a small
    matrix whose eigenvectors turn the sketch into directions.  The entry of most
    weight in each direction is positive, so that signs do not change between runs.
    Null texts are empty and lie at the origin.
    """
    tokens = F.regexp_extract_all(F.lower(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))), F.lit(WORD), 0)
    hashed = F.transform(tokens, lambda w: F.pmod(F.xxhash64(w), F.lit(features)))
    own = df.select(F.col(f"`{id_col}`"), hashed.alias("_f"))
    n = own.count()
    many = own.select(F.explode(F.array_distinct("_f")).alias("f")).groupBy("f").count().collect()  # a row a feature at most
    idf = np.zeros(features)
    for r in many:
        idf[r["f"]] = math.log((n + 1) / (r["count"] + 1))  # as Spark's IDF has it
    width = min(dims + OVERSAMPLE, features)

    def gathered(q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """X'Xq, and the sums of the rows of X."""

        def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            z, total = np.zeros((features, q.shape[1])), np.zeros(features)
            for _, at, feature, x, y in _products(rows, idf, q):
                total += np.bincount(feature, x, features)
                for j in range(q.shape[1]):
                    z[:, j] += np.bincount(feature, x * y[at, j], features)
            flat = np.concatenate([z.ravel(), total])
            there = np.flatnonzero(flat)
            yield pa.RecordBatch.from_arrays([pa.array(there, pa.int64()), pa.array(flat[there], pa.float64())], names=["k", "v"])

        out = np.zeros(features * q.shape[1] + features)
        for r in own.mapInArrow(run, "k bigint, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():  # features x (width + 1) at most
            out[r["k"]] = r["v"]
        return out[: features * q.shape[1]].reshape(features, -1), out[features * q.shape[1] :]

    def covariance(q: np.ndarray) -> np.ndarray:
        z, total = gathered(q)
        return z - np.outer(total, total @ q) / max(n, 1)

    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((features, width)))[0]
    for _ in range(PASSES):
        q = np.linalg.qr(covariance(q))[0]
    small = q.T @ covariance(q)
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    v = q @ vectors[:, np.argsort(-values, kind="stable")[:dims]]
    v = v * np.sign(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])])
    v = np.pad(v, ((0, 0), (0, dims - v.shape[1])))
    names = [f"{stub}_{k + 1}" for k in range(dims)]

    def project(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, _, _, _, y in _products(rows, idf, v):
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(y[:, k]) for k in range(dims))], names=[id_col, *names])

    kind = own.schema[0].dataType
    schema = StructType([StructField(id_col, kind), *(StructField(c, DoubleType()) for c in names)])
    return own.mapInArrow(project, schema)
