"""Chunking strategies: paragraphs, merged by words, by tokens with overlap, and parents with children.

Paragraph rows have doc_id, paragraph_id, text, word_count, hierarchy; sentences, content_type and reference arrays
where known. Chunking works on a document's paragraphs as the array ps of one row (paragraphs.nested() makes it within
the row, without a shuffle); paragraphs that are rows of their own are gathered first, which is the only shuffle. Greedy
packing is one fold over a section's counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyspark.sql.pandas.types import to_arrow_schema

from scriptora.functions import text as T
from scriptora.functions.identity import stable_id
from scriptora.functions.noise import is_skippable_section
from scriptora.functions.tokens import counter, estimate
from scriptora.operators.paragraphs import unnest


@dataclass(frozen=True)
class ChunkConfig:
    """By words. levels: how many of the hierarchy's levels separate sections."""

    min_words: int = 100
    max_words: int = 500
    levels: int = 5
    keep_small: bool = True


@dataclass(frozen=True)
class TokenConfig(ChunkConfig):
    """By tokens."""

    target_tokens: int = 400
    min_tokens: int = 256
    max_tokens: int = 512
    overlap: float = 0.10
    code_max_tokens: int = 256
    absolute_max: int = 2048
    #: A tokenizer's file (and the pattern that ranks need) as functions.tokens takes it; None: the estimate from words.
    tokenizer: str | None = None
    pattern: str | None = None


RETRIEVAL = TokenConfig(target_tokens=320, min_tokens=256, max_tokens=400, overlap=0.15)
RECOMMENDATION = TokenConfig(target_tokens=600, min_tokens=512, max_tokens=700)
BALANCED = TokenConfig(target_tokens=450, min_tokens=400)


def _starts(counts: Column, limit: int) -> Column:
    """Where greedy packing opens a new bin: when the next item would exceed the limit and the bin isn't empty."""
    zero = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).alias("i"), F.array().cast("array<int>").alias("starts"))

    def step(a, n):
        opens = (a["i"] == 0) | (a["total"] + n > limit)
        return F.struct(
            (F.when(opens, F.lit(0).cast("long")).otherwise(a["total"]) + n).alias("total"),
            (a["i"] + 1).alias("i"),
            F.when(opens, F.concat(a["starts"], F.array(a["i"]))).otherwise(a["starts"]).alias("starts"),
        )

    return F.aggregate(counts, zero, step, lambda a: a["starts"])


def section_of(h: Column, levels: int) -> Column:
    """The first levels of a hierarchy; the others are ''."""
    return F.struct(*[(h[x] if i < levels else F.lit("")).alias(x) for i, x in enumerate(T.LEVELS)])


def gather(paragraphs: DataFrame, keep=()) -> DataFrame:
    """One row a document: doc_id, ps in order, with the columns keep of each paragraph."""
    item = F.struct("paragraph_id", "text", F.coalesce("word_count", F.lit(0)).cast("int").alias("word_count"), "hierarchy", *keep)
    ps = F.array_sort(F.collect_list(item), lambda a, b: (a["paragraph_id"] - b["paragraph_id"]).cast("int"))
    return paragraphs.groupBy("doc_id").agg(ps.alias("ps"))


def merge_by_words(paragraphs: DataFrame, config: ChunkConfig = ChunkConfig()) -> DataFrame:
    """Sections packed into chunks of at most max_words; a longer paragraph is a chunk of its own.

    paragraphs: rows, or a row a document with the array ps. Only a section's last chunk is held against min_words: a
    shorter one is flagged, or dropped without keep_small. Where paragraphs have references, sentences, types or OCR
    marks, a chunk inherits them: references distinct in order, sentences in order, one type or 'mixed'.
    """
    if "ps" not in paragraphs.columns:
        paragraphs = gather(paragraphs, [c for c in (*_REFS, *_FIELDS) if c in paragraphs.columns])
    have = [f.name for f in paragraphs.schema["ps"].dataType.elementType.fields]
    kept = F.filter("ps", lambda p: ~is_skippable_section(p["hierarchy"]["level_1"]))
    of = lambda p: section_of(p["hierarchy"], config.levels)
    g = unnest(paragraphs.select("doc_id", kept.alias("ps")), F.array_distinct(F.transform("ps", of)), "hierarchy", "doc_id", "ps")
    g = g.select("doc_id", "hierarchy", F.filter("ps", lambda p: of(p) == F.col("hierarchy")).alias("ps"))
    g = g.withColumn("starts", _starts(F.transform("ps", lambda p: F.coalesce(p["word_count"], F.lit(0)).cast("long")), config.max_words))
    ends = lambda i: F.coalesce(F.get("starts", i + 1), F.size("ps"))
    cut = F.transform("starts", lambda s, i: F.struct(F.slice("ps", s + 1, ends(i) - s).alias("ps"), (i + 1 == F.size("starts")).alias("last")))
    c = unnest(g, cut, "c", "doc_id", "hierarchy").select("doc_id", "hierarchy", "c.ps", "c.last")
    packed = F.aggregate("ps", F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x["word_count"], F.lit(0)))
    c = c.withColumn("small", F.col("last") & (packed < config.min_words))
    if not config.keep_small:
        c = c.where("not small")
    c = c.withColumn("text", F.array_join("ps.text", "\n\n"))
    return c.select(
        "doc_id",
        stable_id(F.col("text")).alias("stable_id"),
        F.get(F.col("ps.paragraph_id"), F.lit(0)).alias("paragraph_id"),
        "text",
        "hierarchy",
        F.concat(F.lit("merged_"), F.size("ps").cast("string"), F.lit("_paragraphs")).alias("source_tag"),
        F.length("text").alias("text_length"),
        T.word_count(F.col("text")).alias("word_count"),
        T.heading_path(F.col("hierarchy")).alias("heading_path"),
        T.hierarchy_depth(F.col("hierarchy")).alias("hierarchy_depth"),
        F.size("ps").alias("source_paragraph_count"),
        F.col("ps.paragraph_id").alias("merged_paragraph_ids"),
        F.when(F.col("small"), F.array(F.lit("below_rag_minimum"))).alias("quality_flags"),
        *[v.alias(k) for k, v in _inherited(have).items()],
    )


_REFS = ("cross_references", "scripture_references", "dates_mentioned")


#: What else a chunk can inherit.
_FIELDS = ("sentences", "content_type", "ocr", "ocr_conf")


def _inherited(have) -> dict[str, Column]:
    """The columns that a chunk gets from the fields of its paragraphs ps."""
    cols = {}
    for a in (*_REFS, "sentences"):
        if a in have:
            flat = F.flatten(F.transform(F.col(f"ps.{a}"), lambda x: F.coalesce(x, F.array().cast("array<string>"))))
            cols[a] = F.array_distinct(flat) if a in _REFS else flat
    if "sentences" in have:
        cols["sentence_count"] = F.size(cols["sentences"])
    if "content_type" in have:
        kinds = F.array_distinct(F.filter(F.col("ps.content_type"), lambda x: x.isNotNull() & (x != "")))
        cols["content_type"] = F.when(F.size(kinds) == 1, F.get(kinds, F.lit(0))).when(F.size(kinds) > 1, "mixed")
    if "ocr" in have:
        cols["ocr"] = F.when(F.exists(F.col("ps.ocr"), lambda x: x.isNotNull()), True)
    if "ocr_conf" in have:
        known = F.filter(F.col("ps.ocr_conf"), lambda x: x.isNotNull())
        cols["ocr_conf"] = F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.size(known))
    return cols


count_tokens = estimate


def tail_overlap(sentences: list[str], share: float, count=count_tokens) -> tuple[list[str], int]:
    """The last sentences that have at least that share of all tokens, and how many tokens they have."""
    sizes = [count(s) for s in sentences]
    wanted = int(sum(sizes) * share) if share > 0 else 0
    if wanted <= 0:
        return [], 0
    total, at = 0, len(sentences)
    while at > 0 and total < wanted:
        at -= 1
        total += sizes[at]
    return sentences[at:], total


def pack_section(ps: list[dict], cfg: TokenConfig, count=count_tokens) -> Iterator[dict]:
    """One section's paragraphs, in order, as chunks: text, ids, sentences, overlap (tokens carried in), small, kind.

    Code stands alone, is cut if it is too long, and ends the chunk before it. A chunk that overflows hands its last
    sentences to the next one.
    """
    from scriptora.operators.code import split_code

    texts: list[str] = []
    members: list[dict] = []
    held: list[str] = []
    tokens = carried = 0

    def chunk(small=False):
        return {"text": "\n\n".join(texts), "ids": [p["paragraph_id"] for p in members], "members": list(members), "overlap": carried, "small": small}

    limit = min(cfg.target_tokens, cfg.max_tokens)
    for p in ps:
        if p.get("content_type") == "code":
            if members:
                yield chunk()
                texts, members, held, tokens, carried = [], [], [], 0, 0
            whole = count(p["text"]) <= cfg.code_max_tokens
            for part in [p["text"]] if whole else split_code(p["text"], "", cfg.code_max_tokens, count) or [p["text"]]:
                yield {"text": part, "ids": [p["paragraph_id"]], "members": [p], "overlap": 0, "small": False}
            continue
        n = count(p["text"])
        if members and tokens + n > limit:
            yield chunk()
            held, tokens = tail_overlap(held, cfg.overlap, count)
            texts, members, carried = ([" ".join(held)] if held else []), [], tokens
        texts.append(p["text"])
        members.append(p)
        tokens += n
        held = held + list(p.get("sentences") or [])
    if members and (tokens >= cfg.min_tokens or cfg.keep_small):
        yield chunk(tokens < cfg.min_tokens)


def pack_document(ps: list[dict], cfg: TokenConfig, count=count_tokens) -> list[dict]:
    """The sections of a document packed, by first paragraph; sections named like an index or contents are left out."""
    sections: dict[tuple, list[dict]] = {}
    for p in sorted(ps, key=lambda p: p["paragraph_id"]):
        levels = tuple((p["hierarchy"] or {}).get(x) or "" for x in T.LEVELS)
        if levels[0].lower() not in ("index", "toc", "contents", "table of contents"):
            sections.setdefault(levels[: cfg.levels] + ("",) * (6 - cfg.levels), []).append(p)
    out = [c | {"levels": k} for k, v in sections.items() for c in pack_section(v, cfg, count)]
    return sorted(out, key=lambda c: c["ids"][0])


def children(sentences: list[str], most: int, count=count_tokens) -> list[list[str]]:
    """Sentences packed greedily under a number of tokens."""
    out: list[list[str]] = []
    total = 0
    for s in sentences:
        n = count(s)
        if not out or total + n > most:
            out.append([])
            total = 0
        out[-1].append(s)
        total += n
    return out


def small_to_big(ps: list[dict], cfg: TokenConfig, count=count_tokens) -> Iterator[dict]:
    """Parents of twice max_tokens without overlap, each before its children; a parent of one child stands alone."""
    from dataclasses import replace

    big = replace(cfg, target_tokens=2 * cfg.max_tokens, max_tokens=2 * cfg.max_tokens, min_tokens=cfg.max_tokens, overlap=0.0)
    for c in pack_document(ps, big, count):
        kinds = {p.get("content_type") for p in c["members"]}
        held = [s for p in c["members"] for s in p.get("sentences") or []]
        kids = [] if kinds == {"code"} else children(held, cfg.max_tokens, count)
        yield c | {"level": "parent" if len(kids) > 1 else "standalone", "child": None}
        if len(kids) > 1:
            for k, s in enumerate(kids):
                yield c | {"text": " ".join(s), "level": "child", "child": k, "overlap": 0, "small": False}


def overlapping(sentences: list[str], cfg: TokenConfig, count=count_tokens) -> Iterator[tuple[str, int, int, bool]]:
    """(text, tokens, sentences, overlaps) against max_tokens; a last chunk below min_tokens is dropped."""
    held: list[str] = []
    total, later = 0, False
    for s in sentences:
        if not s.strip():
            continue
        n = count(s)
        if held and total + n > cfg.max_tokens:
            yield " ".join(held), total, len(held), later
            wanted, later = int(total * cfg.overlap), True
            at = len(held)
            part = 0
            while at > 0 and part < wanted:
                at -= 1
                part += count(held[at])
            # without a wanted overlap, or where all sentences don't reach it, the whole chunk is carried over
            held = held[at if wanted > 0 else 0 :]
            total = sum(map(count, held))
        held.append(s)
        total += n
    if held and total >= cfg.min_tokens:
        yield " ".join(held), total, len(held), later


_NESTED = "array<struct<paragraph_id:int,text:string,word_count:int,hierarchy:struct<level_1:string,level_2:string,level_3:string,level_4:string,level_5:string,level_6:string>,content_type:string,sentences:array<string>,cross_references:array<string>,scripture_references:array<string>,dates_mentioned:array<string>>>"


def nest(paragraphs: DataFrame) -> DataFrame:
    """One row a document: doc_id, ps. Missing types are prose; missing sentences are split from the text.

    paragraphs: rows, or a row a document with the array ps.
    """
    have = set(paragraphs.columns)
    if "ps" not in have:
        paragraphs = gather(paragraphs, [c for c in ("content_type", "sentences", *_REFS) if c in have])
    have = [f.name for f in paragraphs.schema["ps"].dataType.elementType.fields]

    def item(p):
        kind = F.coalesce(p["content_type"], F.lit("prose")) if "content_type" in have else F.lit("prose")
        sents = p["sentences"] if "sentences" in have else T.sentences(p["text"])
        return F.struct(p["paragraph_id"].cast("int").alias("paragraph_id"), p["text"].alias("text"), p["word_count"].cast("int").alias("word_count"), p["hierarchy"].alias("hierarchy"), kind.alias("content_type"), sents.alias("sentences"), *[(p[r] if r in have else F.lit(None).cast("array<string>")).alias(r) for r in _REFS])

    return paragraphs.select("doc_id", F.transform("ps", item).cast(_NESTED).alias("ps"))


def _flat(refs: bool) -> list[Column]:
    """ps as flat arrays, which cost less to hand over than structs: ids, texts, how many sentences each has, the sentences,
    the distinct hierarchies (six strings each), which of them each has if there are several, types unless all are prose,
    and with refs the three references where there are any."""
    none = lambda kind: F.array().cast(f"array<{kind}>")
    held = F.transform(F.col("ps.sentences"), lambda x: F.coalesce(x, none("string")))
    six = F.transform("ps", lambda p: F.array(*[F.coalesce(p["hierarchy"][x], F.lit("")) for x in T.LEVELS]))
    heads = F.array_distinct(six)
    which = F.get(F.transform(F.array(heads), lambda d: F.when(F.size(d) > 1, F.transform(six, lambda h: F.array_position(d, h).cast("int"))).otherwise(none("int"))), F.lit(0))
    kinds = F.when(F.exists(F.col("ps.content_type"), lambda x: ~x.eqNullSafe("prose")), F.col("ps.content_type")).otherwise(none("string"))
    some = lambda r: F.when(F.exists(F.col(f"ps.{r}"), lambda x: F.size(x) > 0), F.transform(F.col(f"ps.{r}"), lambda x: F.coalesce(x, none("string")))).otherwise(none("array<string>"))
    flat = [F.col("ps.paragraph_id"), F.col("ps.text"), F.transform(held, lambda x: F.size(x)), F.flatten(held), F.flatten(heads), which, kinds, *([some(r) for r in _REFS] if refs else [])]
    return [F.coalesce(c, F.array()).alias(f"a{k}") for k, c in enumerate(flat)]


def _unflat(ids, texts, sizes, held, heads, which, kinds, *refs) -> list[dict]:
    """The paragraphs of _flat() again."""
    hs = [dict(zip(T.LEVELS, heads[i : i + 6])) for i in range(0, len(heads), 6)]
    out, at = [], 0
    for k, (i, text, n) in enumerate(zip(ids, texts, sizes)):
        p = {"paragraph_id": i, "text": text, "hierarchy": hs[which[k] - 1 if which else 0], "content_type": kinds[k] if kinds else "prose", "sentences": held[at : at + n]}
        out.append(p | {name: r[k] for name, r in zip(_REFS, refs) if r})
        at += n
    return out


def _rows(nested: DataFrame, f, schema: str, cols: list[str], refs: bool = False) -> DataFrame:
    kind = nested.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            # a document at a time as plain lists and dicts; rows go out by the thousand
            out: list[tuple] = []
            columns = b.columns
            for k in range(b.num_rows):
                i, *ps = [c[k].as_py() for c in columns]
                out += [(i, *r) for r in f(_unflat(*ps))]
                if len(out) > 2000:
                    yield batch(out)
                    out = []
            if out:
                yield batch(out)

    batch = lambda out: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["doc_id", *cols])
    types = [f.type for f in to_arrow_schema(_parse(f"doc_id {kind}, {schema}"))]
    return nested.select("doc_id", *_flat(refs)).mapInArrow(run, f"doc_id {kind}, {schema}")


def _parse(ddl: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(ddl)


def token_aware(nested: DataFrame, cfg: TokenConfig = TokenConfig()) -> DataFrame:
    """doc_id, seq, paragraph_id, text, word_count, tokens, overlap_token_count, merged_paragraph_ids, below_minimum."""

    def f(ps):
        count = counter(cfg.tokenizer, cfg.pattern)
        for k, c in enumerate(pack_document(ps, cfg, count)):
            yield k, c["ids"][0], c["text"], len(c["text"].split()), count(c["text"]), c["overlap"] or None, c["ids"], c["small"]

    cols = ["seq", "paragraph_id", "text", "word_count", "tokens", "overlap_token_count", "merged_paragraph_ids", "below_minimum"]
    return _rows(nested, f, "seq int, paragraph_id int, text string, word_count int, tokens int, overlap_token_count int, merged_paragraph_ids array<int>, below_minimum boolean", cols)


def parents_and_children(nested: DataFrame, cfg: TokenConfig = TokenConfig()) -> DataFrame:
    """doc_id, seq, chunk_level, stable_id, parent_chunk_id, paragraph_id, text, word_count, the six levels and references.

    Children have their parent's levels and those of its references that their own text holds.
    """
    import hashlib

    short = lambda *x: hashlib.sha1("||".join(x).encode()).hexdigest()[:16]

    def f(ps):
        parent, count = "", counter(cfg.tokenizer, cfg.pattern)
        for k, c in enumerate(small_to_big(ps, cfg, count)):
            child = c["level"] == "child"
            own = short(parent, str(c["child"])) if child else short(c["text"])
            refs = [list(dict.fromkeys(r for p in c["members"] for r in p.get(name) or [] if not child or r in c["text"])) for name in _REFS]
            yield k, c["level"], own, parent if child else None, c["ids"][0], c["text"], len(c["text"].split()), *c["levels"], *refs
            parent = parent if child else own

    cols = ["seq", "chunk_level", "stable_id", "parent_chunk_id", "paragraph_id", "text", "word_count", *T.LEVELS, *_REFS]
    more = "".join([*(f", {x} string" for x in T.LEVELS), *(f", {x} array<string>" for x in _REFS)])
    flat = _rows(nested, f, "seq int, chunk_level string, stable_id string, parent_chunk_id string, paragraph_id int, text string, word_count int" + more, cols, refs=True)
    return flat.select(*[c for c in flat.columns if c not in T.LEVELS], F.struct(*T.LEVELS).alias("hierarchy"))


def rechunk(chunks: DataFrame, cfg: TokenConfig = RETRIEVAL) -> DataFrame:
    """Overlapping sentence chunks of each row (doc_id, stable_id, text, sentences): a stateless explode, batch or stream."""
    kind = chunks.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            out = []
            for doc, sid, text, sents in zip(b["doc_id"], b["stable_id"], b["text"], b["sentences"]):
                sents = [] if sents is None else [s for s in sents if s is not None]
                if not any(s.strip() for s in sents):
                    sents = [text] if text and text.strip() else []
                for t, n, k, over in overlapping(sents, cfg):
                    parts = [t] if n <= cfg.absolute_max else [" ".join(x) for x in children(_sentences(t), cfg.absolute_max)]
                    for part in parts:
                        if count_tokens(part) >= cfg.min_tokens:
                            out.append((doc, sid, part, count_tokens(part), k, over))
            yield pd.DataFrame(out, columns=["doc_id", "source_chunk_id", "text", "token_count", "sentence_count", "is_overlap"])

    return chunks.select("doc_id", "stable_id", "text", "sentences").mapInPandas(
        run, f"doc_id {kind}, source_chunk_id string, text string, token_count int, sentence_count int, is_overlap boolean"
    )


def _sentences(text: str) -> list[str]:
    """The sentence rule for strings on the executors."""
    import re

    held = re.sub(r"\b(" + "|".join(re.escape(a) for a in sorted(T.ABBREVIATIONS, key=len, reverse=True)) + r")\. ", "\\1.\0", text)
    parts = [s.replace("\0", " ").strip() for s in re.split(T.SENTENCE_END, held)]
    return [s for s in parts if s]


def rechunk_statistics(chunks: DataFrame) -> DataFrame:
    """One row of totals over token_count, sentence_count and, where it is there, crossed_hierarchy_boundary; zeros for no chunks."""
    crossed = F.col("crossed_hierarchy_boundary") if "crossed_hierarchy_boundary" in chunks.columns else F.lit(False)
    zero = lambda c: F.coalesce(c, F.lit(0))
    return chunks.agg(
        F.count("*").alias("total_chunks"),
        zero(F.sum("token_count")).alias("total_tokens"),
        zero(F.avg("token_count")).alias("avg_tokens"),
        zero(F.min("token_count")).alias("min_tokens"),
        zero(F.max("token_count")).alias("max_tokens"),
        zero(F.avg("sentence_count")).alias("avg_sentences"),
        F.count_if(crossed).alias("hierarchy_crossings"),
    )


STRATEGIES = {
    **dict.fromkeys(("nlp", "paragraph"), lambda p, c: p),
    **dict.fromkeys(("embeddings", "rag", "semantic"), lambda p, c: merge_by_words(p, c or ChunkConfig())),
    **dict.fromkeys(("technical", "token_aware"), lambda p, c: token_aware(nest(p), c or TokenConfig())),
    "small_to_big": lambda p, c: parents_and_children(nest(p), c or TokenConfig()),
}


def apply_strategy(name: str, paragraphs: DataFrame, config: ChunkConfig | None = None) -> DataFrame:
    if name not in STRATEGIES:
        raise ValueError(f"no chunking strategy {name!r}; there are {', '.join(sorted(STRATEGIES))}")
    if config is not None and name in ("small_to_big", "technical", "token_aware") and not isinstance(config, TokenConfig):
        raise TypeError(f"{name} takes a TokenConfig, not a {type(config).__name__}")
    return STRATEGIES[name](paragraphs, config)
