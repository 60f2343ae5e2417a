"""Abusive, hateful or sexual content (problem 10): nearest labelled passages by exact TF-IDF cosine.

1. Documents are brought to plain spelling and cut into passages of at most PASSAGE words. The passages are written once
   to the shared folder; equal passages of the corpus are scored once.
2. Examples are the passages of at most LABELLED_ROWS labelled documents (those with the least hash of their id, where
   there are more) and the SEEDS below. As labels are of documents and partly wrong, each passage first gets a label of
   its own, from what its words and its near passages in the other labelled documents tell of it. Where they leave it
   open, a passage of OFTEN labelled documents or more counts as much as they say, another isn't an example.
3. Weights are tf * idf, for every word with its document frequency over all passages of the corpus. Only the frequencies
   of the examples' words are known beforehand; the others' are bounded by the most frequent of them, and those of the few
   passages that may be near by this bound are fetched by a join, so the cosines are exact.
4. The examples stand in a block-max inverted index. Terms whose weights can't reach LEAST_COSINE together open no
   candidates; blocks of candidates whose bound stays below it are skipped; the rest get their exact cosine. A passage
   whose cosine to every abusive example is below LEAST_COSINE has the score 0.
5. The NEIGHBOURS nearest vote, weighted with the square of what their cosine exceeds LEAST_COSINE by. The vote of a
   document is that of its worst passage, made a probability by a logistic curve that is fitted to the votes of the
   labelled documents without their own examples. Found is what has a probability of FOUND or more.

Defined results: null, empty and blank texts have the score 0; of several labels of a document the majority counts, a tie
or null labels only are no label; without any labels the seeds alone decide; repeated rows give one result; a null
doc_id is left out; empty tables give no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.spelling import sentences
from orrery.session import cut, new_folder

LABELLED_ROWS = 20_000
PASSAGE, STRIDE = 14, 9
LEAST_COSINE, NEAR, NEIGHBOURS, BLOCK = 0.42, 0.5, 9, 64
FOUND = 0.5
#: Evidence of a passage: below LOW its words say no, from HIGH on yes; from LIKELY on it is an abusive example, below LOW a
#: clean one. PRIOR is how many documents the usual share weighs.
LOW, HIGH, LIKELY, PRIOR, OFTEN = 0.3, 0.55, 0.47, 3, 3

# Examples of abusive, hateful and sexual passages.
_BAD = """you are a complete idiot and everybody knows it
you are such a moron
shut up you idiot nobody asked for your opinion
shut your mouth you stupid fool
go to hell you bastard
fuck you
fuck off and die you piece of shit
what a fucking moron wrote this
you stupid bitch
son of a bitch
you worthless piece of garbage
only an idiot would write code like this
kill yourself
do us all a favour and kill yourself
i hope you die
i hope you get cancer
i will kill you
i know where you live and i will find you
i am going to hurt you
i will beat you up
i will break your legs
watch your back we will get you
you make me sick you filthy pig
you are a disgrace and should be ashamed you loser
nobody likes you get lost you loser
your mother is a whore
those people are vermin and should be wiped out
all immigrants are criminals and should be thrown out
these people are subhuman
women are too stupid to program
women belong in the kitchen
gays are disgusting and should not exist
jews control everything and must be stopped
muslims are all terrorists
black people are stupid
disabled people should not be allowed here they disgust me
send me nude photos of you
show me your tits
show me your naked body
i want to fuck you
i want to have sex with you tonight
suck my dick
hot naked girls on cam click here
free porn videos xxx
spread your legs for me
let me touch you
come to my room tonight for sex
take off your clothes
your parents raised a loser
you should just die
your face looks like a toilet
i never met a bigger idiot
foreigners have no brain and ruin everything
all foreigners are a disease
they breed like rats and steal our jobs
old people are useless and should shut up
your boobs look great in that shirt
sit on my lap babe
i am so horny for you
halt die fresse du idiot
du bist so ein arschloch
verpiss dich du hurensohn
du bist dumm wie brot
du vollidiot verpiss dich endlich
du trottel dein code ist mull wie du
ich hau dir in die fresse
alle auslander sind dreck
ich bring dich um
ich weiss wo du wohnst
dein code ist mull wie du
auslander raus
frauen gehoren in die kuche
zeig mir deine titten
ich will mit dir schlafen
ferme ta gueule espece de con
va te faire foutre
tu es un idiot et un incapable
sale connard degage
espece d'abruti ferme ta gueule et degage d'ici
tu es une merde et ton code aussi
je sais ou tu habites
les etrangers sont des parasites
je vais te tuer
les femmes ne savent pas programmer
les immigres dehors
envoie moi des photos de toi nue
je veux coucher avec toi
callate idiota
eres un imbecil
vete a la mierda
eres un inutil y un idiota largate
se donde vives
los extranjeros son basura que se larguen
hijo de puta
te voy a matar
las mujeres no sirven para programar
fuera los inmigrantes
mandame fotos desnuda
quiero acostarme contigo
死ね
お前は馬鹿だ
殺してやる
黙れこの野郎
気持ち悪い消えろ
裸の写真を送れ
去死吧
你是个白痴
你这个蠢货滚开
我要杀了你
发裸照给我
他妈的废物""".split("\n")
# Examples of passages that use the same words and are none.
_GOOD = """kill the process before you restart the daemon
kill the child process with sigkill
the worker was killed by the kernel
abort the transaction before you drop the table
the master and the slave replica disagree
the dumb terminal does not support colours
execute the query and dump the result
the garbage collector frees the dead objects
the form has the fields name sex and age
the column sex of the patient table is optional
the blocklist contains the word idiot
comments with insults will be removed by the moderators
please do not use words such as stupid in reviews
the rule forbids threats and insults in comments
naked pointers are forbidden by the style guide
strip the debug symbols from the binary
the male and the female connector
the attack surface of the endpoint is small
orphaned children of a killed parent are adopted by init
hang and crash of the server under load
this is a stupid mistake of mine sorry
what a horrible stack trace the bug is a real pain
the test is a bit dumb but works
the virus scanner deletes the file
the bastard operator column name comes from the upstream schema
violent changes of the load break the pool
the sandbox executes untrusted code
destroy the old index and build it anew
den prozess beenden bevor der dienst startet
le processus est tue par le noyau
matar el proceso antes de reiniciar""".split("\n")


def _cut(words: list[str]) -> Iterator[str]:
    if len(words) <= PASSAGE:
        yield " ".join(words)
        return
    for at in range(0, len(words) - PASSAGE + STRIDE, STRIDE):
        yield " ".join(words[at : at + PASSAGE])


def passages(text: str | None) -> list[str]:
    """Distinct passages of a text in plain spelling, in order."""
    if not text or not text.strip():
        return []
    return list(dict.fromkeys(p for s in sentences(text) for p in _cut(s) if len(p) > 1))


def _to_passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 1000):
            part = batch.slice(start, 1000)
            ids, out = [], []
            for d, t in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                found = passages(t)
                ids += [d] * len(found)
                out += found
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.string())], ["doc_id", "passage"])


SEEDS_BAD = sorted({p for t in _BAD for p in passages(t)})
SEEDS_GOOD = sorted({p for t in _GOOD for p in passages(t)})


class Index:
    """Block-max inverted index over passages with unit TF-IDF vectors; exact cosines above a bound."""

    def __init__(self, texts: list[str], idf: dict[str, float], usual: float):
        self.texts, self.idf, self.usual = texts, idf, usual
        self.terms: dict[str, int] = {}
        rows, cols, vals = [], [], []
        for i, t in enumerate(texts):
            v = self.vector(t)
            for w, x in v.items():
                rows.append(i)
                cols.append(self.terms.setdefault(w, len(self.terms)))
                vals.append(x)
        rows, cols, vals = np.array(rows, np.int64), np.array(cols, np.int64), np.array(vals)
        self.row_at = np.searchsorted(rows, np.arange(len(texts) + 1))
        self.cols, self.vals = cols, vals
        order = np.lexsort((rows, cols))
        self.term_at = np.searchsorted(cols[order], np.arange(len(self.terms) + 1))
        self.post_rows, self.post_vals = rows[order], vals[order]
        self.most = np.array([self.post_vals[a:b].max() for a, b in zip(self.term_at, self.term_at[1:])]) if len(self.terms) else np.zeros(0)
        self.blocks: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for k, (a, b) in enumerate(zip(self.term_at, self.term_at[1:])):
            block = self.post_rows[a:b] // BLOCK
            at = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
            self.blocks[k] = (block[at], np.maximum.reduceat(self.post_vals[a:b], at))
        self.n_blocks = len(texts) // BLOCK + 1
        self.by_size: dict[int, list[str]] = defaultdict(list)
        for w in self.terms:
            self.by_size[len(w)].append(w)
        self.scratch = np.zeros(len(self.terms) + 1)

    def unmask(self, word: str) -> str:
        """The word of the index that a word with masked letters stands for: the rarest that fits."""
        if "*" not in word or not word.strip("*"):
            return word
        pattern = re.compile("".join(".{1,%d}" % len(x) if x[0] == "*" else re.escape(x) for x in re.findall(r"\*+|[^*]+", word)))
        fits = [w for n in range(max(1, len(word) - word.count("*")), len(word) + 1) for w in self.by_size.get(n, ()) if pattern.fullmatch(w)]
        return max(fits, key=lambda w: (self.idf.get(w, self.usual), w)) if fits else word

    def vector(self, text: str, others: dict[str, float] | None = None) -> dict[str, float]:
        counts = Counter(text.split(" "))
        others = others or {}
        v = {w: (1 + math.log(n)) * (self.idf.get(w) or others.get(w, self.usual)) for w, n in counts.items()}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1.0
        return {w: x / norm for w, x in v.items()}

    def near(self, text: str, least: float, others: dict[str, float] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(rows, cosines) of all examples with at least this cosine, exactly, if `others` has the idf of the words that `idf` lacks."""
        if "*" in text:
            text = " ".join(self.unmask(w) for w in text.split(" "))
        q = [(self.terms[w], x) for w, x in self.vector(text, others).items() if w in self.terms]
        if not q:
            return np.zeros(0, np.int64), np.zeros(0)
        q.sort(key=lambda t: t[1] * self.most[t[0]])
        reach = np.cumsum([x * self.most[t] for t, x in q])
        if reach[-1] < least:
            return np.zeros(0, np.int64), np.zeros(0)
        first = int(np.searchsorted(reach, least, "left"))  # the terms before can't reach it together
        bound = np.zeros(self.n_blocks)
        for t, x in q:
            block, most = self.blocks[t]
            bound[block] += x * most
        rows = np.unique(np.concatenate([self.post_rows[self.term_at[t] : self.term_at[t + 1]] for t, _ in q[first:]]))
        rows = rows[bound[rows // BLOCK] >= least]
        if not len(rows):
            return rows, np.zeros(0)
        for t, x in q:
            self.scratch[t] = x
        a, b = self.row_at[rows], self.row_at[rows + 1]
        size = b - a
        at = np.repeat(a - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
        cos = np.add.reduceat(self.scratch[self.cols[at]] * self.vals[at], np.r_[0, np.cumsum(size)[:-1]])
        for t, _ in q:
            self.scratch[t] = 0
        ok = cos >= least - 1e-12
        return rows[ok], cos[ok]


def vote(labels: np.ndarray, cos: np.ndarray) -> float:
    """Distance-weighted vote of the nearest; equal cosines at the end of the list all count."""
    if not len(cos):
        return 0.0
    if len(cos) > NEIGHBOURS:
        keep = cos >= np.partition(cos, -NEIGHBOURS)[-NEIGHBOURS] - 1e-12
        labels, cos = labels[keep], cos[keep]
    w = ((cos - LEAST_COSINE) / (1 - LEAST_COSINE) + 0.02) ** 2
    return float((w * labels).sum() / w.sum())


class Judge:
    """The fitted examples: an index of the abusive ones alone, to dismiss most passages, and one of all."""

    def __init__(self, examples: list[tuple[str, float, int | None]], idf: dict[str, float], usual: float):
        self.examples = sorted(set(examples), key=lambda e: (e[0], e[1], -1 if e[2] is None else e[2]))
        self.labels = np.array([y for _, y, _ in self.examples], float)
        self.of_document = np.array([-1 if d is None else d for _, _, d in self.examples], np.int64)
        self.idf = idf
        bad = [t for t, y, _ in self.examples if y >= LIKELY]
        self.bad = Index(bad, idf, usual)
        self.all = Index([t for t, _, _ in self.examples], idf, usual)
        self.slope, self.shift = 8.0, -4.0
        #: (idf, greatest weight in an abusive example) of the words of those.
        self.reach = {w: (idf.get(w, usual), float(self.bad.most[t])) for w, t in self.bad.terms.items()}

    def plain(self, passage: str) -> str:
        """The passage with words of masked letters replaced by the words of the abusive examples they stand for."""
        return " ".join(self.bad.unmask(w) for w in passage.split(" ")) if "*" in passage else passage

    def may_be_near(self, plain: str) -> bool:
        """False only if no abusive example can have LEAST_COSINE, whatever the idf of the words that no example has.

        They're taken to be as frequent as the most frequent of such words, so the norm is at most, and the cosine at least,
        what it really is.
        """
        if "*" not in plain:
            reach = size = 0.0
            words = plain.split(" ")
            for w in set(words) if len(words) > 1 else words:
                weight, most = self.reach.get(w) or (self.idf.get(w) or self.bad.usual, 0.0)
                if len(words) > 1 and words.count(w) > 1:
                    weight *= 1 + math.log(words.count(w))
                size += weight * weight
                reach += weight * most
            if reach * reach < size * (LEAST_COSINE - 1e-9) ** 2:  # its words can't reach it even together
                return False
        return bool(len(self.bad.near(plain, LEAST_COSINE)[0]))

    def unknown(self, plain: str) -> list[str]:
        return [w for w in dict.fromkeys(plain.split(" ")) if w not in self.idf]

    def score(self, plain: str, others: dict[str, float] | None = None, without: int | None = None) -> tuple[float, int]:
        """(vote, number of the nearest example or -1), without the examples of one document."""
        if not len(self.bad.near(plain, LEAST_COSINE, others)[0]):
            return 0.0, -1
        rows, cos = self.all.near(plain, LEAST_COSINE, others)
        if without is not None:
            keep = self.of_document[rows] != without
            rows, cos = rows[keep], cos[keep]
        if not len(rows) or self.labels[rows].max() < LIKELY:
            return 0.0, -1
        return vote(self.labels[rows], cos), int(rows[np.argmax(cos * (0.001 + self.labels[rows]))])

    def probability(self, score: float) -> float:
        return 0.0 if score <= 0 else 1 / (1 + math.exp(-(self.slope * score + self.shift)))


def label_passages(docs: dict[int, tuple[int, list[str]]], idf: dict[str, float], usual: float) -> tuple[list[tuple[str, float, int | None]], dict[int, float]]:
    """Examples from labelled documents, and the leave-one-out evidence of each document.

    The evidence of a passage is the mean, weighted by idf, of the shares of abusive ones among the other labelled
    documents (and seeds) with its words. Between LOW and HIGH, where words leave it open, the near passages of other
    documents vote too. Shares are drawn to the usual share, as if PRIOR more documents had been seen.
    """
    n_bad = sum(y for y, _ in docs.values())
    usual_share = min(0.25, max(0.1, (n_bad + 1) / (len(docs) + 4)))
    words: dict[str, list[float]] = defaultdict(lambda: [0.0, 0.0])
    for y, ps in docs.values():
        for w in {w for p in ps for w in p.split(" ")}:
            words[w][y] += 1
    for y, seeds in ((1, SEEDS_BAD), (0, SEEDS_GOOD)):
        for t in seeds:
            for w in set(t.split(" ")):
                words[w][y] += 1

    def by_words(p: str, y: int | None) -> float:
        up = down = 0.0
        for w in p.split(" "):
            good, bad = words.get(w, (0.0, 0.0))
            if y == 1:
                bad -= 1
            elif y == 0:
                good -= 1
            x = idf.get(w, usual)
            up += x * (max(bad, 0) + PRIOR * usual_share) / (max(bad, 0) + max(good, 0) + PRIOR)
            down += x
        return up / down if down else 0.0

    where: dict[str, list[float]] = defaultdict(lambda: [0.0, 0.0])
    for y, ps in docs.values():
        for p in ps:
            where[p][y] += 1
    for y, seeds in ((1, SEEDS_BAD), (0, SEEDS_GOOD)):
        for t in seeds:
            where[t][y] += 1
    texts = sorted(where)
    row = {t: i for i, t in enumerate(texts)}
    counts = np.array([where[t] for t in texts]).reshape(-1, 2)
    index: Index | None = None
    judged: dict[tuple[str, int], float] = {}
    for d, (y, ps) in sorted(docs.items()):
        for p in ps:
            if (p, y) in judged:
                continue
            e = by_words(p, y)
            if LOW <= e < HIGH:
                index = index or Index(texts, idf, usual)
                rows, cos = index.near(p, NEAR)
                seen = counts[rows].copy()
                seen[rows == row[p], y] -= 1
                w = cos[:, None] ** 2 * seen
                e = (w[:, 1].sum() + PRIOR * usual_share) / (w.sum() + PRIOR)
            judged[p, y] = e
    examples: dict[str, tuple[float, int | None]] = {}
    for t in SEEDS_GOOD:
        examples[t] = (0, None)
    for t in SEEDS_BAD:
        examples[t] = (1, None)
    scores = {}
    for d, (y, ps) in sorted(docs.items()):
        scores[d] = max((judged[p, y] for p in ps), default=0.0)
        for p in ps:
            e = judged[p, y]
            if LOW <= e < LIKELY and counts[row[p]].sum() < OFTEN:  # of neither kind
                continue
            bad = 1 if e >= LIKELY else 0 if e < LOW else e  # between, as likely as its words and neighbours say
            if p not in examples or bad > examples[p][0]:
                examples[p] = (bad, d)
    return [(t, y, d) for t, (y, d) in examples.items()], scores


def _fit_curve(points: list[tuple[float, int]]) -> tuple[float, float]:
    """Logistic curve by Newton's method, with a weak prior."""
    if len({y for _, y in points}) < 2:
        return 8.0, -4.0
    x, y = np.array([p for p, _ in points]), np.array([y for _, y in points], float)
    t = np.array([8.0, -4.0])
    prior = t.copy()
    a = np.c_[x, np.ones_like(x)]
    for _ in range(12):
        p = 1 / (1 + np.exp(-np.clip(a @ t, -30, 30)))
        g = a.T @ (p - y) + 1.0 * (t - prior)
        h = (a * (p * (1 - p))[:, None]).T @ a + 1.0 * np.eye(2)
        t = t - np.linalg.solve(h, g)
    return float(t[0]), float(t[1])


class AbuseScores:
    """Scores of all documents. `passages` is a written table (doc_id, passage)."""

    def __init__(self, documents: DataFrame, labels: DataFrame, labelled_rows: int = LABELLED_ROWS):
        spark = documents.sparkSession
        self.documents = documents
        path = new_folder(spark)
        rows = documents.where(F.col("doc_id").isNotNull()).select("doc_id", "text")
        rows.where(F.length(F.trim("text")) > 0).mapInArrow(_to_passages, "doc_id long, passage string").write.parquet(path)
        self.passages = spark.read.parquet(path)
        votes = labels.where(F.col("abusive").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.avg("abusive").alias("a")).where("a <> 0.5")
        chosen = votes.select("doc_id", F.when(F.col("a") > 0.5, 1).otherwise(0).alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled_rows)
        docs: dict[int, tuple[int, list[str]]] = {}
        for r in self.passages.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.collect_set("passage").alias("ps")).collect():  # at most labelled_rows
            docs[r.doc_id] = (r.y, sorted(r.ps))
        vocabulary = {w for _, ps in docs.values() for p in ps for w in p.split(" ")} | {w for t in SEEDS_BAD + SEEDS_GOOD for w in t.split(" ")}
        wanted = F.broadcast(spark.createDataFrame([(w,) for w in sorted(vocabulary)], "term string"))  # at most the examples' vocabulary
        self.n = self.passages.count()
        terms = self.passages.select(F.explode(F.array_distinct(F.split("passage", " "))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        #: Passages that hold each term, of all terms of the corpus.
        self.terms = cut(terms)
        df = {r.term: r.df for r in self.terms.join(wanted, "term").collect()}
        most = self.terms.join(wanted, "term", "left_anti").agg(F.coalesce(F.max("df"), F.lit(0))).first()[0]
        idf = {w: self._idf(df.get(w, 0)) for w in vocabulary}
        examples, _ = label_passages(docs, idf, self._idf(0))
        self.judge = Judge(examples, idf, self._idf(most))
        #: (vote without the document's own examples, label) of each labelled document.
        self.points = [(max((self.judge.score(self.judge.plain(p), without=d)[0] for p in ps), default=0.0), y) for d, (y, ps) in sorted(docs.items())]
        self.judge.slope, self.judge.shift = _fit_curve(self.points)

    def _idf(self, df: float) -> float:
        return math.log(1 + self.n / (1 + df))

    def quality(self) -> dict[str, float]:
        """Found and missed labelled documents, each judged without its own examples; some of the labels are wrong."""
        found = [(self.judge.probability(v) >= FOUND, y) for v, y in self.points]
        hit, bad, flagged = sum(f and y for f, y in found), sum(y for _, y in found), sum(f for f, _ in found)
        return {"documents": len(found), "abusive": bad, "found": flagged, "both": hit, "recall": hit / bad if bad else 0.0, "precision": hit / flagged if flagged else 0.0}

    def scored_passages(self) -> DataFrame:
        """(passage, vote, near_text, near_doc) of the distinct passages with a vote above 0.

        First the bound: it needs no idf but those of the examples and leaves few passages. Only their other words get
        their idf, by a join with the terms of the corpus, so that the cosines are exact.
        """
        shared = self.documents.sparkSession.sparkContext.broadcast(self.judge)  # bounded by LABELLED_ROWS

        def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            judge = shared.value
            for batch in batches:
                out = []
                for p in batch.column("passage").to_pylist():
                    plain = judge.plain(p)
                    if judge.may_be_near(plain):
                        out.append((p, plain, judge.unknown(plain)))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.string(), pa.string(), pa.list_(pa.string())))], ["passage", "plain", "words"])

        def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            judge = shared.value
            for batch in batches:
                out = []
                for p, plain, others in zip(*(batch.column(c).to_pylist() for c in ("passage", "plain", "others"))):
                    v, near = judge.score(plain, {x["term"]: x["idf"] for x in others or ()})
                    if v > 0:
                        t, _, d = judge.examples[near]
                        out.append((p, v, t, d))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.string(), pa.float64(), pa.string(), pa.int64()))], ["passage", "vote", "near_text", "near_doc"])

        left = cut(self.passages.select("passage").distinct().mapInArrow(bound, "passage string, plain string, words array<string>"))
        idf = F.log(1 + F.lit(float(self.n)) / (1 + F.coalesce("df", F.lit(0))))
        words = left.select("passage", F.explode("words").alias("term")).join(self.terms, "term", "left").groupBy("passage").agg(F.collect_list(F.struct("term", idf.alias("idf"))).alias("others"))  # of one passage
        return left.join(words, "passage", "left").select("passage", "plain", "others").mapInArrow(exact, "passage string, vote double, near_text string, near_doc long")

    def scores(self) -> DataFrame:
        """(doc_id, vote, score, evidence, near_text, near_doc), one row per document."""
        worst = self.passages.join(self.scored_passages(), "passage").groupBy("doc_id").agg(F.max(F.struct("vote", F.col("passage").alias("evidence"), "near_text", "near_doc")).alias("w"))
        ids = self.documents.where(F.col("doc_id").isNotNull()).select("doc_id").distinct()
        curve = 1 / (1 + F.exp(-(F.lit(self.judge.slope) * F.col("vote") + F.lit(self.judge.shift))))
        return ids.join(worst, "doc_id", "left").select("doc_id", F.coalesce("w.vote", F.lit(0.0)).alias("vote"), "w.evidence", "w.near_text", "w.near_doc").withColumn("score", F.when(F.col("vote") > 0, F.round(curve, 6)).otherwise(0.0))

    def found(self) -> DataFrame:
        return self.scores().where(F.col("score") >= FOUND).select("doc_id")

    def rates(self) -> DataFrame:
        """(source, n_docs, n_abusive, rate, mean_score) per source, compared trimmed and in lower case."""
        source = F.coalesce(F.lower(F.trim("source")), F.lit("")).alias("source")
        docs = self.documents.where(F.col("doc_id").isNotNull()).select("doc_id", source).distinct()
        bad = F.when(F.col("score") >= FOUND, 1).otherwise(0)
        return docs.join(self.scores(), "doc_id").groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(bad).alias("n_abusive"), F.round(F.avg(bad), 6).alias("rate"), F.round(F.avg("score"), 6).alias("mean_score"))
