"""Subject areas of documents: label propagation over a verified graph of documents.

Documents are linked through the words they share. As pairs of documents grow with the square of the corpus, a
word's pairs are kept as one class row (document - word - document), which carries the same flow. A link is
verified twice: the word must speak for a subject (its rate there against its rates elsewhere, by the labels of
the round), and it carries a document's subject only as far as word and document agree on it; words that are
evidently common to all subjects link nothing. Labels flow from the trusted seeds (labelled documents,
what the subjects are about, and the test items as a class of their own) over documents and words and back by
DataFrame joins, round by round until they settle. Seeds are clamped in every round. A document
keeps several subjects. At the end each document's sentences are counted exactly, by the words that carry links.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspan.llm.leakage import _BACK, _BASE, _WORD, _powers, plain
from loomspan.session import checkpointed, chunks, column, laid_out

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".?!"]] = True
_GAP = np.zeros(256, bool)
_GAP[[ord(c) for c in " \t\r\n"]] = True


class Sentences:
    """Words of many texts with the sentence each belongs to.

    A sentence ends with ``. ? !`` before a blank, quote or bracket, or the end of the text; a line break before anything but a
    lower-case letter, and the end of a text, end what is no sentence (greetings, headings, notes). Words are
    32-bit hashes (two of the few that carry links seldom meet another); those of which half or more are figures are codes.
    """

    def __init__(self, texts: list[str], langs: list[str] | None = None):
        self.langs = langs or [""] * len(texts)
        raw = [t.encode("utf-8", "replace") for t in texts]
        original = np.frombuffer(b"\n\n".join(raw) + b"\n\n", np.uint8)
        data = _LOWER[original]
        size = len(data)
        index = np.arange(size)
        solid = np.where(_GAP[original], size - 1, index)
        following = original[np.minimum.accumulate(solid[::-1])[::-1]]
        after = np.append(original[1:], 10)
        closing = _GAP[after] | np.isin(after, np.frombuffer(b"\"')]}|", np.uint8))
        stop = _STOP[original] & closing
        lower = (following >= 97) & (following <= 122)
        line = (original == 10) & ~lower
        text_end = np.cumsum(np.fromiter((len(x) + 2 for x in raw), np.int64, len(raw))) - 1
        line[text_end] = True
        border = stop | line
        number = np.cumsum(border) - border  # border characters belong to the sentence they end
        is_word = _WORD[data]
        edge = np.diff(is_word.astype(np.int8), prepend=0)
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        stream = data[is_word]
        upto = np.cumsum(is_word)
        start, finish = upto[begin] - 1, upto[end]
        prefix = np.zeros(len(stream) + 1, np.uint64)
        np.cumsum((stream.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(stream) + 1)[:-1], out=prefix[1:])
        self.word = ((prefix[finish] - prefix[start]) * _powers(_BACK, len(stream) + 1)[start] >> np.uint64(32)).astype(np.uint32).view(np.int32)
        self.word[self.word == 0] = 1  # 0 counts sentences
        figures = np.concatenate([[0], np.cumsum((stream >= 48) & (stream <= 57))])
        self.code = 2 * (figures[finish] - figures[start]) >= finish - start
        ended_by_stop = stop[np.flatnonzero(border)]
        used, self.sentence = np.unique(number[begin], return_inverse=True)
        self.whole = ended_by_stop[used]
        self.doc = np.searchsorted(text_end, np.flatnonzero(border)[used], side="left")


def speaking(mass: np.ndarray, sentences: np.ndarray, prior: float, thin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rate of each word in each class and its share of the rates of all classes.

    ``mass`` has a row per word, then languages and classes: in how many sentences of the class the word is;
    ``sentences`` is the number of sentences by language and class. A class is measured by what its own mix
    of languages would hold of the word, so the small words of a language speak for no class, and a language of
    one class only tells nothing. ``prior`` sentences at the word's overall rate are added to each class. Classes marked ``thin``, of which no sentence is known yet but what the subject is said
    to be about, have a rate in those words only.
    """
    parts, mass, by_class = mass, mass.sum(axis=1), sentences.sum(axis=0)
    overall = mass.sum(axis=1, keepdims=True) / max(by_class.sum(), 1e-9)
    expected = (parts.sum(axis=2) / np.maximum(sentences.sum(axis=1), 1e-9)) @ sentences
    rate = np.where(by_class > 0, overall * (mass + prior * overall + 1e-9) / (expected + prior * overall + 1e-9), 0)
    rate[thin & (mass == 0)] = 0
    return rate, rate / np.maximum(rate.sum(axis=1, keepdims=True), 1e-12)


def _texts(docs: DataFrame, id_col: str, text: str, lang: str | None) -> DataFrame:
    tongue = F.lower(F.substring(F.trim(lang), 1, 2)) if lang in docs.columns else F.lit(None).cast("string")
    return docs.where(F.col(id_col).isNotNull() & F.col(text).isNotNull()).select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text).alias("text"), F.coalesce(tongue, F.lit("")).alias("lang"))


def _blocks(batches: Iterable[pa.RecordBatch], chars: int, also: str = "lang") -> Iterator[tuple[list[int], Sentences, list]]:
    """Ids, sentences and a further column of many texts at once."""
    ids: list[int] = []
    langs: list[str] = []
    texts: list[str] = []
    more: list = []
    held = 0
    for table in chunks(iter(batches), 1):
        for i, t, g, m in zip(*(column(table, c).to_pylist() for c in ("doc_id", "text", "lang", also))):
            ids.append(i)
            langs.append(g)
            more.append(m)
            texts.append(plain(t, lower=False))
            held += len(t)
            if held >= chars:
                yield ids, Sentences(texts, langs), more
                ids, texts, langs, more, held = [], [], [], [], 0
    if ids:
        yield ids, Sentences(texts, langs), more


COUNTED = "word int, class int, weight double"
EDGES = "doc_id bigint, lang string, words array<int>, ends array<int>"


def _once(s: Sentences, some: np.ndarray) -> np.ndarray:
    """Places among ``some`` of the first mention of a word in a sentence, by sentence."""
    order = some[np.lexsort((s.word[some], s.sentence[some]))]
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(s.sentence[order]) != 0) | (np.diff(s.word[order]) != 0)
    return order[new]


def _statements(ids: list[int], s: Sentences, common: np.ndarray) -> pa.RecordBatch:
    """Words of each document's whole sentences without common words and codes, and where each sentence ends among them."""
    usable = s.whole[s.sentence] & ~s.code
    if len(common):
        at = np.minimum(np.searchsorted(common, s.word), len(common) - 1)
        usable &= common[at] != s.word
    places = _once(s, np.flatnonzero(usable))
    sentences = np.flatnonzero(s.whole)
    ends = np.searchsorted(s.sentence[places], sentences, side="right")
    docs = np.arange(len(ids) + 1)
    by_doc, of_doc = np.searchsorted(s.doc[s.sentence[places]], docs), np.searchsorted(s.doc[sentences], docs)
    ends = ends - by_doc[s.doc[sentences]]
    lists = [pa.ListArray.from_arrays(pa.array(o.astype(np.int32)), pa.array(v.astype(np.int32))) for o, v in ((by_doc, s.word[places]), (of_doc, ends))]
    return pa.RecordBatch.from_arrays([pa.array(np.array(ids, np.int64)), pa.array(s.langs, pa.string()), *lists], names=["doc_id", "lang", "words", "ends"])


def subject_shares(docs: DataFrame, labels: DataFrame, items: DataFrame | None = None, subjects: DataFrame | None = None, *, id_col: str = "doc_id", text: str = "text", label: str = "subject", item_text: str = "text", about: str = "about", lang: str | None = "lang", most_rounds: int = 12, settled: float = 0.02, most_langs: int = 50, chunk_chars: int = 4_000_000) -> DataFrame:
    """``doc_id, subject, sentences, of, share``: how many of a document's ``of`` sentences are about each subject.

    Labels compare trimmed and in lower case; null ids and labels don't count. Passages in the manner of
    ``items`` and lines that are no sentences (greetings, headings) are left out of both numbers. A
    document without a subject, or with a null or empty text, gives no row. Copies are all classified.

    ``subjects`` names all subjects and what each is ``about``; those words are a trusted seed besides the
    labelled documents, so a subject that no label notes is found too. Without it the subjects are those noted.

    A round (1) gives every document the subjects its linking words speak for, seeds only those noted for them, and
    (2) gives every word the subjects of its documents: a mention goes to the word's subject where the document has it,
    else to the document's. Rounds end when the shares of the mentioned words move by less than ``settled`` on average,
    or after ``most_rounds``. All documents and all labels take part. The texts are read twice: the labelled ones for the first
    words, then all of them for the links, which are laid out by document once; a round shuffles sums per word only.

    All whole sentences teach words; a word's rate in a class is held against that of the class's mix of languages
    (first two letters of ``lang``, the ``most_langs`` most common ones apart), so that small words don't pass for
    subject words. Words are scored and picked on the workers; only those that speak for a class, or that every class
    has in one sentence of a thousand or more, go to the driver: their number follows the words of a sentence, not the corpus.
    """
    spark = docs.sparkSession
    source = _texts(docs, id_col, text, lang)
    noted = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("doc_id"), F.lower(F.trim(label)).alias("label")).where("label <> ''")
    told: list[tuple[str, str]] = []
    if subjects is not None:
        told = [(r[0], r[1] or "") for r in subjects.where(F.col(label).isNotNull()).select(F.lower(F.trim(label)), F.col(about)).where(F.trim(label) != "").collect()]
    names = sorted({r[0] for r in noted.select("label").distinct().collect()} | {n for n, _ in told})
    if not names:
        return spark.createDataFrame([], "doc_id bigint, subject string, sentences bigint, of bigint, share double")
    code = {n: i for i, n in enumerate(names)}
    other = len(names)  # passages in the manner of test items
    none = other + 1  # about no subject
    count = none + 1
    spoken = [r[0] for r in source.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_langs).collect()] or [""]
    tongue = {g: i for i, g in enumerate(spoken)}  # items and what subjects are about count to the main language
    tongues = len(spoken) + 1  # the rest together
    numbered = F.create_map(*[F.lit(x) for n in names for x in (n, code[n])])
    seeds = noted.groupBy("doc_id").agg(F.array_sort(F.collect_set(numbered[F.col("label")])).alias("noted"))

    def counts(s: Sentences, classes: list[np.ndarray], weight: float = 1.0, own: bool = True) -> pa.RecordBatch:
        """Counts of words by language and class, and of sentences as word 0; ``classes`` are those of each document."""
        per_doc = np.array([len(c) for c in classes], np.int64)
        places = _once(s, np.flatnonzero(s.whole[s.sentence] & ~s.code))
        doc = np.concatenate([s.doc[s.sentence[places]], s.doc[s.whole]])
        words = np.concatenate([s.word[places], np.zeros(len(doc) - len(places), np.int32)])
        n = per_doc[doc]
        first = np.cumsum(per_doc) - per_doc
        at = np.repeat(first[doc] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        of_doc = np.array([tongue.get(g, tongues - 1) if own else 0 for g in s.langs], np.int64)
        flat = np.concatenate([*classes, np.zeros(0, np.int64)]).astype(np.int64)[at] + count * np.repeat(of_doc[doc], n)
        keys, where = np.unique((np.repeat(words, n).astype(np.int64) << 32) + flat, return_inverse=True)
        sums = np.bincount(where, weights=np.repeat(weight / np.maximum(n, 1), n), minlength=len(keys))
        return pa.RecordBatch.from_arrays([pa.array((keys >> 32).astype(np.int32)), pa.array((keys & 0xFFFFFFFF).astype(np.int32)), pa.array(sums)], names=["word", "class", "weight"])

    def seed_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, s, mine in _blocks(batches, chunk_chars, "noted"):
            yield counts(s, [np.array(m, np.int64) for m in mine])

    def item_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, s, _ in _blocks(batches, chunk_chars):
            s.whole[:] = True
            yield counts(s, [np.array([other])] * len(ids), own=False)

    def gather(parts: DataFrame, excess: float, common: float, prior: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Words that speak for a class with their shares and mentions, and the words common to all; picked on the workers.

        A word is kept if its share in one class is clear, by ``excess`` of the way from an even share to 1, and its rate there is at least ``common`` times that
        of the class's 20th most common clear word: rarer words that happen to fall into one class prove nothing.
        As the rates of a class add up to the words of a sentence, this bounds the words of a class whatever
        the size of the corpus.
        """
        total = checkpointed(parts.groupBy("word", "class").agg(F.sum("weight").alias("weight")))
        sentences = np.zeros(tongues * count)
        for r in total.where("word = 0").collect():
            sentences[r["class"]] = r["weight"]
        sentences = sentences.reshape(tongues, count)
        thin = sentences.sum(axis=0) <= told_weight
        live = np.count_nonzero(~thin[: len(names)])
        even = 1 / (min(live + 1, len(names)) if live else len(names))  # share of a word that goes with no subject in particular
        clear, dull = even + excess * (1 - even), even + 0.2 * (1 - even)
        often = max(50.0, sentences.sum() / 1000)
        by_word = total.where("word <> 0").groupBy("word").agg(F.sum("weight").alias("n"), F.collect_list("class").alias("classes"), F.collect_list("weight").alias("weights"))

        def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t in chunks(iter(batches), 4096):
                classes = column(t, "classes")
                mass = np.zeros((len(classes), tongues * count))
                mass[np.repeat(np.arange(len(classes)), np.diff(classes.offsets.to_numpy())), classes.flatten().to_numpy()] = column(t, "weights").flatten().to_numpy()
                rate, share = speaking(mass.reshape(-1, tongues, count), sentences, prior, thin)
                best, top = share.argmax(axis=1), share.max(axis=1)
                keep = np.flatnonzero((top >= clear) | ((top < dull) & (mass.sum(axis=1) >= often)))
                shares = pa.ListArray.from_arrays(pa.array(np.arange(len(keep) + 1, dtype=np.int32) * count), pa.array(share[keep].ravel()))
                best = np.where(top[keep] >= clear, best[keep], -1)
                yield pa.RecordBatch.from_arrays([column(t, "word").take(pa.array(keep)), pa.array(best.astype(np.int32)), pa.array(rate[keep, best]), column(t, "n").take(pa.array(keep)), shares], names=["word", "best", "rate", "n", "shares"])

        scored = checkpointed(by_word.where("n >= 2").mapInArrow(score, "word int, best int, rate double, n double, shares array<double>"))
        top = scored.withColumn("place", F.row_number().over(Window.partitionBy("best").orderBy(F.desc("rate"), "word"))).where("place <= 20 and best >= 0")
        least = top.groupBy("best").agg((common * F.min("rate")).alias("least"))
        rows = scored.join(F.broadcast(least), "best").where("rate >= least").select("word", "n", "shares").orderBy("word").collect()  # one row per class on the right
        dull_words = np.sort(np.array([r[0] for r in scored.where("best < 0").select("word").collect()], np.int32))
        return np.array([r.word for r in rows], np.int32), np.array([r.shares for r in rows]).reshape(-1, count), np.array([r.n for r in rows]), dull_words

    told_weight = np.zeros(count)
    fixed = spark.createDataFrame([], COUNTED)
    if told:  # what a subject is said to be about, as two sentences of it: the least support a word needs
        s = Sentences([plain(t, lower=False) for _, t in told])
        s.whole[:] = True
        spoken_of = pa.Table.from_batches([counts(s, [np.array([code[n]]) for n, _ in told], 2.0, own=False)])
        for w, c, x in zip(*(spoken_of[k].to_pylist() for k in ("word", "class", "weight"))):
            told_weight[c] += x if w == 0 else 0
        fixed = fixed.unionByName(spark.createDataFrame(spoken_of).select(F.col("word").cast("int"), F.col("class").cast("int"), "weight"))
    if items is not None:
        item_source = items.where(F.col(item_text).isNotNull()).select(F.lit(0).cast("bigint").alias("doc_id"), F.col(item_text).alias("text"), F.lit("").alias("lang"))
        fixed = fixed.unionByName(item_source.mapInArrow(item_counts, COUNTED))
    fixed = checkpointed(fixed)
    seeded = source.join(seeds, "doc_id")
    words, shares, _, dull = gather(seeded.mapInArrow(seed_counts, COUNTED).unionByName(fixed), 0.3, 0.3, 20.0)

    def edges(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, s, _ in _blocks(batches, chunk_chars):
            yield _statements(ids, s, dull)

    tongue_of = F.coalesce(F.create_map(*[F.lit(x) for g in spoken for x in (g, tongue[g])])[F.col("lang")], F.lit(tongues - 1)).cast("int")
    placed = source.mapInArrow(edges, EDGES).select("doc_id", tongue_of.alias("tongue"), "words", "ends")
    graph = laid_out(placed.join(seeds, "doc_id", "left"), "doc_id")

    def linking(words: np.ndarray, shares: np.ndarray) -> DataFrame:
        """The linking words with the class each speaks for; broadcast as long as they are as few as they should be."""
        parts = {"word": pa.array(words), "class": pa.array(shares.argmax(axis=1).astype(np.int32)), "s": pa.array(shares.max(axis=1, initial=0))}
        rows = spark.createDataFrame(pa.table(parts), "word int, class int, s double")
        return F.broadcast(rows) if len(words) <= 200_000 else rows

    def labels_of(links: DataFrame) -> DataFrame:
        """``graph`` with ``now``: the subjects of each document as (class, s), s adding up to 1. By document throughout: no shuffle."""
        told_by = graph.select("doc_id", F.explode("words").alias("word")).join(links.where(F.col("class") != none), "word")
        per_doc = told_by.groupBy("doc_id", "class").agg(F.sum("s").alias("s")).groupBy("doc_id").agg(F.collect_list(F.struct("class", "s")).alias("scores"), F.sum("s").alias("total"))
        strong = F.when(F.col("total") >= 2, F.filter("scores", lambda x: x["s"] * 6 >= F.col("total")))
        strong = F.coalesce(strong, F.array().cast("array<struct<class:int,s:double>>"))
        alike = F.transform("noted", lambda c: F.struct(c.alias("class"), F.lit(1.0).alias("s")))
        agreed = F.filter("strong", lambda x: F.array_contains("noted", x["class"]))
        clamped = F.when(F.col("noted").isNull(), F.col("strong")).when(F.size(agreed) > 0, agreed).otherwise(alike)
        joined = graph.join(per_doc.hint("shuffle_hash"), "doc_id", "left").withColumn("strong", strong).withColumn("clamped", clamped)
        # the rest of a document speaks for none; a sentence on a subject holds about two words of it
        quiet = F.when(F.size("clamped") == 0, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.col("total") / (2 * F.size("ends"))))
        weighed = joined.withColumn("quiet", F.coalesce(quiet, F.lit(0.0)))
        total = F.aggregate("clamped", F.lit(0.0), lambda a, x: a + x["s"])
        even = F.transform("clamped", lambda x: F.struct(x["class"].alias("class"), (x["s"] * (1 - F.col("quiet")) / total).alias("s")))
        rest = F.array(F.struct(F.lit(none).alias("class"), F.col("quiet").alias("s")))
        now = F.when(F.col("quiet") == 0, even).when(F.col("quiet") == 1, rest).otherwise(F.concat(even, rest))
        return weighed.select("doc_id", "tongue", "words", F.size("ends").alias("n"), now.alias("now"))

    def masses(links: DataFrame) -> DataFrame:
        """Where a word's class is one of the document's, the mention is that class's; else the document's subjects share it."""
        labelled = labels_of(links).where(F.size("now") > 0).withColumn("classes", F.col("now.class"))
        mentions = labelled.select("tongue", "now", "classes", "n", F.explode(F.concat("words", F.array(F.lit(0)))).alias("word")).join(links.drop("s"), "word", "left")
        flow = F.when(F.array_contains("classes", F.col("class")), F.array(F.struct("class", F.lit(1.0).alias("s")))).otherwise(F.col("now"))
        spread = mentions.select("tongue", "word", F.when(F.col("word") == 0, F.col("n")).otherwise(1).alias("times"), F.inline(flow).alias("to", "s"))
        return spread.groupBy("word", (F.col("to") + F.col("tongue") * count).cast("int").alias("class")).agg(F.sum(F.col("s") * F.col("times")).alias("weight")).unionByName(fixed)

    for _ in range(most_rounds):
        before = dict(zip(words.tolist(), shares))
        words, shares, often, _ = gather(masses(linking(words, shares)), 0.565, 0.15, 0.0)
        nothing = np.zeros(count)
        moved = sum(n * np.abs(now - before.get(w, nothing)).sum() for w, now, n in zip(words.tolist(), shares, often)) / max(often.sum(), 1)
        if moved <= settled:
            break

    def classify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in chunks(iter(batches), 4096):
            flat, ends, ids = column(t, "words"), column(t, "ends"), column(t, "doc_id")
            end = ends.flatten().to_numpy()
            of_doc = np.repeat(np.arange(len(ids)), np.diff(ends.offsets.to_numpy()))
            start = np.where(np.diff(of_doc, prepend=-1) != 0, 0, np.concatenate([[0], end[:-1]])) if len(end) else end
            sentence = np.repeat(np.arange(len(end)), end - start)
            word = flat.flatten().to_numpy()
            total = np.zeros((len(end), count))
            if len(words) and len(word):
                at = np.minimum(np.searchsorted(words, word), len(words) - 1)
                hit = words[at] == word
                sentence, share = sentence[hit], shares[at[hit]]
                if len(sentence):
                    first = np.flatnonzero(np.diff(sentence, prepend=-1))
                    total[sentence[first]] = np.add.reduceat(share, first, axis=0)
            best = np.where(total.max(axis=1, initial=0) >= 0.8, total.argmax(axis=1), -1)
            of = np.bincount(of_doc[best != other], minlength=len(ids))
            found = np.zeros((len(ids), count), np.int64)
            use = (best >= 0) & (best < other)
            np.add.at(found, (of_doc[use], best[use]), 1)
            d, c = np.nonzero(found)
            n = found[d, c]
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(d)), pa.array([*names, "", ""], pa.string()).take(pa.array(c)), pa.array(n), pa.array(of[d].astype(np.int64)), pa.array(n / np.maximum(of[d], 1))],
                names=["doc_id", "subject", "sentences", "of", "share"],
            )

    return graph.select("doc_id", "words", "ends").mapInArrow(classify, "doc_id bigint, subject string, sentences bigint, of bigint, share double")

