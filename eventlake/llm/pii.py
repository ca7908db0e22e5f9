"""Information-theoretic sanitisation of personal data.

1. *Entities*: e-mail, IP, card and phone spans (exact per-kind rules).
2. *Terms*: all words outside the entities of a document that holds one, or,
   where a ``window`` is given, those within ``window`` words of an entity.
3. *Corpus co-occurrence*: with N documents, the number of documents that hold
   entity e, term t, and both give the
   pointwise mutual information ``PMI(e;t) = log2(N * c(e,t) / (c(e) * c(t)))``
   and the information content ``IC(e) = -log2(c(e)/N)``.  A term discloses e
   when ``PMI >= alpha * IC(e)`` and ``support`` documents or more hold both.
   PMI is at most IC(e), so alpha is the share of e's information that t must
   give; with 0.8, the share of t's documents that hold e must be
   ``(c(e)/N) ** 0.2`` or more: 0.25 for an entity in a thousandth of them.
4. A disclosing term that shares a word shape class with the entity's kind (it
   holds a digit or an ``@``) is generalised to its shape, any other is removed.

Counts cover every document.  Word counts are combined per task before the
shuffle; the pairs of words and entities are thin rows, of entities and words
that ``support`` documents hold; only the texts' own findings travel back to
their documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlake.llm.common import written
from eventlake.llm.textcols import text_array

# fixed values: kinds in the order in which they are listed
KINDS = ("email", "ip", "card", "phone", "term")

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a match never starts inside a run of digits: what fails at its first digit fails at the others
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_EDGE = "\"'()[]{}<>.,;:!?|"
_EDGE_BYTES = _EDGE.encode()

SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
SPAN_DDL = "array<struct<kind:string,start:bigint,end:bigint>>"


def luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = ord(ch) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses, found from each ``@`` outwards (linear)."""
    out, free = [], 0
    at = text.find("@")
    while at >= 0:
        s = at
        while s > free and text[s - 1] in _LOCAL:
            s -= 1
        m = _DOMAIN.match(text, at) if s < at else None
        if m:
            out.append((s, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return out


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the four base kinds; failing matches use up their text."""
    out = []
    if "@" in text:
        out += [(s, e, "email") for s, e in emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(int(p[-4:]) <= 255 and len(p.lstrip("0")) <= 3 for p in m.group().split(".")):
                out.append((m.start(), m.end(), "ip"))
        for m in _CARD.finditer(text):
            d = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), m.end(), "card"))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
                    out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))


def _outside(text: str, spans: list[tuple[int, int, str]]) -> tuple[list[tuple[int, int]], np.ndarray, list[tuple[int, int]]]:
    """(words, which of them an entity covers, each entity's first word and the one after its last)."""
    found = [(m.start(), m.end()) for m in _WORD.finditer(text)]
    starts = np.array([s for s, _ in found])
    ends = np.array([e for _, e in found])
    taken = np.zeros(len(found), dtype=bool)
    place = []
    for s, e, _ in spans:
        a = int(np.searchsorted(ends, s, side="right"))
        b = int(np.searchsorted(starts, e, side="left"))
        taken[a:b] = True
        place.append((a, b))
    return found, taken, place


def free_words(text: str, spans: list[tuple[int, int, str]]) -> list[tuple[str, int, int]]:
    """(term, start, end) of every word of the text that no entity covers."""
    found, taken, _ = _outside(text, spans)
    out = []
    for (s, e), covered in zip(found, taken, strict=True):
        core = "" if covered else text[s:e].strip(_EDGE)
        if core:
            at = s + text[s:e].index(core)
            out.append((core.lower(), at, at + len(core)))
    return out


def _near(text: str, spans: list[tuple[int, int, str]], window: int) -> list[tuple[str, int, int, str]]:
    """(term, start, end, entity) of words near each entity, entities excluded."""
    found, taken, place = _outside(text, spans)
    out = []
    for (a, b), (s, e, kind) in zip(place, spans, strict=True):
        entity = f"{kind}:{text[s:e]}"
        for i in [*range(max(0, a - window), a), *range(b, min(len(found), b + window))]:
            if taken[i]:
                continue
            word = text[found[i][0]:found[i][1]]
            core = word.strip(_EDGE)
            if core:
                at = found[i][0] + word.index(core)
                out.append((core.lower(), at, at + len(core), entity))
    return out


def _distinct_words(text: str) -> set[bytes]:
    return {w.strip(_EDGE_BYTES) for w in set(text.lower().encode("utf-8").split())}


def find_entities(docs: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """Per document: base spans, the terms near them, and all words of a document with such terms."""
    id_type = docs.schema[id_col].dataType.simpleString()
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    near_type = pa.list_(pa.struct([("term", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("entity", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = text_array(batch.column("text"))
            for lo in range(0, len(col), 512):
                spans, near, held = [], [], []
                for i in range(lo, min(lo + 512, len(col))):
                    text = col[i].as_py()
                    found = base_spans(text)
                    spans.append([{"kind": k, "start": s, "end": e} for s, e, k in found])
                    near.append([{"term": t, "start": s, "end": e, "entity": x} for t, s, e, x in (_near(text, found, window) if found else ())])
                    held.append(list({w.decode() for w in _distinct_words(text) if w} | {x["term"] for x in near[-1]}) if near[-1] else [])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(lo, 512), pa.array(spans, type=SPAN_TYPE), pa.array(near, type=near_type), pa.array(held, type=pa.list_(pa.string()))],
                    names=["id", "spans", "near", "words"])

    return src.mapInArrow(
        run, f"id {id_type}, spans {SPAN_DDL}, near array<struct<term:string,start:bigint,end:bigint,entity:string>>, words array<string>")



def _count_batch(counts: dict[bytes, int]) -> pa.RecordBatch:
    counts.pop(b"", None)
    return pa.RecordBatch.from_arrays(
        [pa.array(list(counts), type=pa.binary()).cast(pa.string()), pa.array(list(counts.values()), type=pa.int64())], names=["term", "n"])


def word_document_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """(term, n): for every word of the corpus the number of documents that hold it.

    Each task adds up its documents' distinct words, so the shuffle carries
    about one row per distinct word and task.  A word is lower-cased and
    stripped of edge punctuation.
    """
    src = docs.select(F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = text_array(batch.column("text"))
            counts: dict[bytes, int] = {}
            for lo in range(0, len(col), 256):          # a few texts as Python strings at a time
                for text in col.slice(lo, 256).to_pylist():
                    for w in _distinct_words(text):
                        counts[w] = counts.get(w, 0) + 1
                if len(counts) > 200_000:           # bounded memory: Spark adds the parts up
                    yield _count_batch(counts)
                    counts = {}
            yield _count_batch(counts)

    return src.mapInArrow(run, "term string, n bigint").groupBy("term").agg(F.sum("n").alias("n"))


def entities_held(found: DataFrame) -> DataFrame:
    """(row, entity) of each document's entities that have a word near them."""
    return found.select("row", F.explode(F.array_distinct(F.transform("near", lambda x: x["entity"]))).alias("entity"))


def document_pairs(found: DataFrame, pairs: DataFrame) -> DataFrame:
    """(entity, term), once for every document that holds both, of ``pairs``
    (entity, term and the documents that hold them: n_entity, n).

    Each pair meets the shorter of its two document lists first, then the other
    by (row, key): never all words of a document with all its entities."""
    held = entities_held(found)
    words = written(found.select("row", F.explode("words").alias("term")).join(pairs.select("term").distinct(), "term", "left_semi"), "pii-words")
    by_entity = held.join(pairs.where("n_entity < n").select("entity", "term"), "entity").join(words, ["row", "term"])
    by_term = words.join(pairs.where("n_entity >= n").select("entity", "term"), "term").join(held, ["row", "entity"])
    return by_entity.select("entity", "term").unionByName(by_term.select("entity", "term"))


def disclosing_pairs(found: DataFrame, counts: DataFrame, n_docs: int, alpha: float, support: int) -> DataFrame:
    """(entity, term, pmi, ic) of the pairs over the disclosure threshold.

    ``PMI - IC`` is ``log2(c(e,t) / c(t))``, compared so: exact at the maximum."""
    n = F.lit(float(n_docs))
    ic = -F.log2(F.col("n_entity") / n)
    share = lambda both: F.log2(both / F.greatest(F.col("n"), both))
    entities = entities_held(found).groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity"))
    # no more documents than hold either can hold both: what that excludes needs no count
    most = F.least("n_entity", "n")
    pairs = (found.select(F.explode(F.transform("near", lambda x: F.struct(x["entity"].alias("entity"), x["term"].alias("term")))).alias("p"))
             .select("p.entity", "p.term").distinct().join(entities, "entity").join(counts, "term").withColumn("ic", ic)
             .where((F.col("ic") > 0) & (F.col("n_entity") >= support) & (share(most) >= (alpha - 1) * F.col("ic"))))
    pairs = written(pairs, "pii-pairs")
    both = document_pairs(found, pairs).groupBy("entity", "term").agg(F.count(F.lit(1)).alias("both"))
    strong = pairs.join(both, ["entity", "term"]).where((F.col("both") >= support) & (share(F.col("both")) >= (alpha - 1) * F.col("ic")))
    return strong.select("entity", "term", (F.col("ic") + share(F.col("both"))).alias("pmi"), "ic")


def find_holders(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per document: base spans and, where there are any, the entities, all words and the text."""
    id_type = docs.schema[id_col].dataType.simpleString()
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = text_array(batch.column("text"))
            for lo in range(0, len(col), 512):
                spans, entities, held, texts = [], [], [], []
                for i in range(lo, min(lo + 512, len(col))):
                    text = col[i].as_py()
                    found = base_spans(text)
                    spans.append([{"kind": k, "start": s, "end": e} for s, e, k in found])
                    entities.append(list({f"{k}:{text[s:e]}" for s, e, k in found}))
                    held.append(list({w.decode() for w in _distinct_words(text) if w} | {t for t, _, _ in free_words(text, found)}) if found else [])
                    texts.append(text if found else None)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(lo, 512), pa.array(spans, type=SPAN_TYPE), pa.array(entities, type=pa.list_(pa.string())),
                     pa.array(held, type=pa.list_(pa.string())), pa.array(texts, type=pa.string())], names=["id", "spans", "entities", "words", "text"])

    return src.mapInArrow(run, f"id {id_type}, spans {SPAN_DDL}, entities array<string>, words array<string>, text string")


def whole_text_terms(found: DataFrame, counts: DataFrame, n_docs: int, alpha: float, support: int) -> DataFrame:
    """(row, terms): the terms of each document that disclose one of its entities,
    all its words being candidates.

    Only entities and words that ``support`` documents hold can make a pair; a
    word in more documents than any entity's threshold allows cannot either."""
    n = F.lit(float(n_docs))
    share = lambda both: F.log2(both / F.greatest(F.col("n"), both))
    each = found.select("row", F.explode("entities").alias("entity"))
    known = (each.groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity")).withColumn("ic", -F.log2(F.col("n_entity") / n))
             .where((F.col("ic") > 0) & (F.col("n_entity") >= support)))
    held = written(each.join(known, "entity"), "pii-held")
    most = held.agg(F.max(F.col("n_entity") * F.pow(F.lit(2.0), (1 - alpha) * F.col("ic")))).first()[0] or 0.0
    some = counts.where((F.col("n") >= support) & (F.col("n") <= most * (1 + 1e-9)))
    words = written(found.join(held.select("row").distinct(), "row", "left_semi").select("row", F.explode("words").alias("term")).join(some, "term"), "pii-words")
    over = lambda both: share(both) >= (alpha - 1) * F.col("ic")
    both = (held.join(words, "row").where(over(F.least("n_entity", "n"))).groupBy("entity", "term")
            .agg(F.count(F.lit(1)).alias("both"), F.first("n").alias("n"), F.first("ic").alias("ic")))
    strong = written(both.where((F.col("both") >= support) & over(F.col("both"))).select("entity", "term"), "pii-strong")
    there = words.join(strong.select("term").distinct(), "term", "left_semi")
    return (held.join(there, "row").join(strong, ["entity", "term"], "left_semi")
            .groupBy("row").agg(F.collect_set("term").alias("terms")))


def placed_terms(found: DataFrame, terms: DataFrame) -> DataFrame:
    """(row, terms): the spans of every occurrence of each document's terms outside its entities."""
    src = found.where("text IS NOT NULL").select("row", "spans", "text").join(terms, "row").select("row", "spans", "text", "terms")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                out = []
                for text, spans, own in zip(*[part.column(c).to_pylist() for c in ("text", "spans", "terms")], strict=True):
                    wanted = set(own)
                    found = free_words(text, [(x["start"], x["end"], x["kind"]) for x in spans])
                    out.append([{"kind": "term", "start": s, "end": e} for t, s, e in found if t in wanted])
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(out, type=SPAN_TYPE)], names=["row", "terms"])

    return src.mapInArrow(run, f"row bigint, terms {SPAN_DDL}")


def scan_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int | None = None,
                       alpha: float = 0.8, support: int = 2) -> DataFrame:
    """One row per document: ``<id_col>, spans`` (base kinds and ``term``).

    Every word of a document is a candidate for its entities; ``window`` narrows
    that to the words so near an entity.  Offsets are code points, end exclusive.
    Null text counts as empty and has no spans; a null id stays null; repeated
    rows are scanned each and count each; other columns are ignored; an empty
    table gives an empty result.
    """
    if window is None:
        found = find_holders(docs, id_col, text_col)
    else:
        found = find_entities(docs, id_col, text_col, window)
    found = written(found.withColumn("row", F.monotonically_increasing_id()), "pii-found")
    counts = word_document_counts(docs, text_col)
    # the written row number keeps repeated ids apart
    if window is None:
        hits = placed_terms(found, whole_text_terms(found, counts, found.count(), alpha, support))
    else:
        pairs = disclosing_pairs(found, counts, found.count(), alpha, support)
        hits = (found.where(F.size("near") > 0).select("row", F.explode("near").alias("x"))
                .select("row", "x.entity", "x.term", "x.start", "x.end").join(pairs.select("entity", "term"), ["entity", "term"], "left_semi")
                .groupBy("row").agg(F.collect_set(F.struct(F.lit("term").alias("kind"), "start", "end")).alias("terms")))
    own = F.coalesce("terms", F.array().cast(SPAN_DDL))
    order = F.array(*[F.lit(k) for k in KINDS])
    spans = F.array_sort(F.concat("spans", own), lambda a, b: F.when(
        F.struct(a["start"], F.array_position(order, a["kind"]), a["end"]) < F.struct(b["start"], F.array_position(order, b["kind"]), b["end"]), -1)
        .when(F.struct(a["start"], F.array_position(order, a["kind"]), a["end"]) > F.struct(b["start"], F.array_position(order, b["kind"]), b["end"]), 1).otherwise(0))
    return found.select("row", "id", "spans").join(hits, "row", "left").select(F.col("id").alias(id_col), spans.alias("spans"))


def generalised(term: str) -> str:
    """A term's shape: digits to 0, letters to x, or nothing for a plain word."""
    if not any(c.isdigit() or c == "@" for c in term):
        return ""
    return re.sub(r"[0-9]", "0", re.sub(r"[^\W\d_]", "x", term))


def sanitise(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``<id_col>, text``: base spans become ``<KIND>``, terms their shape or nothing.

    ``spans`` is the result of :func:`scan_personal_data` over the same documents.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    src = (docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
           .join(spans.select(F.col(id_col).alias("id"), "spans"), "id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, found in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                parts, at = [], 0
                for x in found:
                    if x["end"] <= at:
                        continue
                    if x["start"] >= at:
                        word = text[x["start"]:x["end"]]
                        parts += [text[at:x["start"]], generalised(word) if x["kind"] == "term" else f"<{x['kind'].upper()}>"]
                    at = x["end"]
                out.append("".join([*parts, text[at:]]))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, type=pa.string())], names=["id", "text"])

    return src.mapInArrow(run, f"id {id_type}, text string").select(F.col("id").alias(id_col), F.col("text").alias(text_col))
