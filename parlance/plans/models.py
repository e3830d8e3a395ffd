"""Models behind interfaces, each with a deterministic stand-in. They run once for each meeting, in Arrow batches, and return
an error column instead of failing the job."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance import schemas
from parlance.functions import constants as C
from parlance.functions.text import clean_null, json_object, strip, token_estimate, white_tokens

M = "meeting_id"


class Embedder(Protocol):
    def __call__(self, samples: np.ndarray) -> np.ndarray: ...


class Transcriber(Protocol):
    """Hears samples: dicts of start, end, text, avg_logprob and words (word, start, end, probability)."""

    def __call__(self, samples: np.ndarray) -> list[dict]: ...


class ChatModel(Protocol):
    """Answers a system and a user text with text that should be JSON."""

    def __call__(self, system: str, user: str) -> str: ...


def tone_embedder(samples: np.ndarray, bands: int = 16) -> np.ndarray:
    """Stand-in: energy by band of frequency, so that pure tones of different pitch lie apart."""
    power = np.abs(np.fft.rfft(np.asarray(samples, dtype=np.float64))) ** 2
    out = np.array([b.sum() for b in np.array_split(power[: max(bands, len(power) // 4)], bands)])
    return out / max(1e-12, np.linalg.norm(out))


def silent_model(system: str, user: str) -> str:
    """Stand-in: proposes and claims nothing."""
    return "{}"


class ScriptedModel:
    """Stand-in: a fixed reply for users' texts that hold a phrase."""

    def __init__(self, replies: dict[str, dict]):
        self.replies = replies

    def __call__(self, system: str, user: str) -> str:
        return next((json.dumps(r) for k, r in self.replies.items() if k in user), "{}")


def embed_chunks(chunks: DataFrame, audio: DataFrame, embedder: Callable[[], Embedder], rate: int = 16_000) -> DataFrame:
    """chunks with `embedding` (null for tiny ones). audio: (meeting_id, pcm float32). `embedder` makes the model, once for
    each worker's stream. A chunk is heard with 0.1 s on either side, within the recording."""
    item = F.struct("chunk_idx", "start", "end", "kind")
    rows = chunks.groupBy(M).agg(F.array_sort(F.collect_list(item)).alias("c")).join(audio.select(M, "pcm"), M)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = embedder()
        pad = int(C.PAD_S * rate)
        for pdf in batches:
            for meeting, cs, pcm in zip(pdf[M], pdf["c"], pdf["pcm"], strict=True):
                x = np.frombuffer(pcm, np.float32)
                cut = lambda c, x=x: x[max(0, int(c["start"] * rate) - pad) : min(len(x), int(c["end"] * rate) + pad)]
                yield pd.DataFrame({M: meeting, "chunk_idx": [c["chunk_idx"] for c in cs], "embedding": [None if c["kind"] == "tiny" else [float(v) for v in model(cut(c))] for c in cs]})

    made = rows.mapInPandas(run, f"{M} {dict(chunks.dtypes)[M]}, chunk_idx int, embedding array<double>")
    return chunks.join(made, [M, "chunk_idx"], "left")


SPOKEN = "array<struct<segment_id:int,start:double,end:double,text:string,avg_logprob:double,words:array<struct<word:string,start:double,end:double,probability:double>>>>"


def available(model: Callable[[], object]) -> bool:
    """Whether a model can be made here: its packages and files are there."""
    try:
        model()
    except Exception:  # noqa: BLE001 - whatever is missing, the answer is no
        return False
    return True


def transcribe(audio: DataFrame, transcriber: Callable[[], Transcriber]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(segments, words, errors) of audio (meeting_id, pcm float32). `transcriber` makes the model, once for each worker's
    stream; it takes samples and returns segments as dicts (start, end, text, avg_logprob, words). A recording that fails has a
    row (meeting_id, error) and no segments."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = transcriber()
        for pdf in batches:
            for meeting, pcm in zip(pdf[M], pdf["pcm"], strict=True):
                try:
                    heard, error = [{"segment_id": k, **s} for k, s in enumerate(model(np.frombuffer(pcm, np.float32)))], None
                except Exception as e:  # noqa: BLE001 - a recording that cannot be heard leaves the others alone
                    heard, error = None, str(e) or type(e).__name__
                yield pd.DataFrame({M: [meeting], "heard": [heard], "error": [error]})

    kind = dict(audio.dtypes)[M]
    rows = audio.select(M, "pcm").mapInPandas(run, f"{M} {kind}, heard {SPOKEN}, error string")
    segments = rows.select(M, F.explode("heard").alias("s")).select(M, "s.*")
    words = segments.select(M, "segment_id", F.posexplode("words").alias("word_idx", "w")).select(M, "segment_id", "word_idx", "w.*", F.lit(None).cast("string").alias("speaker"))
    return segments.drop("words"), words, rows.where("error is not null").select(M, "error")


def ask(prompts: DataFrame, model: Callable[[], ChatModel], fallback: Callable[[], ChatModel] | None = None) -> DataFrame:
    """prompts (meeting_id, system, user) with `reply`, `error` and `fell_back`. A failing model is tried again as `fallback`;
    what fails there too has an error and no reply."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, second = model(), fallback() if fallback else None
        for pdf in batches:
            replies, errors, fell = [], [], []
            for system, user in zip(pdf["system"], pdf["user"], strict=True):
                reply, error, again = None, None, False
                for k, m in enumerate(x for x in (first, second) if x):
                    try:
                        reply, again = m(system, user), k > 0
                        break
                    except Exception as e:  # noqa: BLE001 - a failing model degrades its meeting only
                        error = f"{error}; {e}" if error else str(e) or type(e).__name__
                replies.append(reply)
                errors.append(error)
                fell.append(again)
            yield pdf[[M]].assign(reply=replies, error=errors, fell_back=fell)

    return prompts.select(M, "system", "user").mapInPandas(run, f"{M} {dict(prompts.dtypes)[M]}, reply string, error string, fell_back boolean")


def route(meetings: DataFrame, mode: str = "auto", has_remote: bool = True) -> DataFrame:
    """Adds tokens, backend (remote or local) and size warnings to (meeting_id, text)."""
    tokens = token_estimate(F.col("text"))
    remote = F.lit(mode == "remote" and has_remote) | (F.lit(mode == "auto" and has_remote) & (tokens <= C.REMOTE_TOKENS))
    rows = meetings.withColumn("tokens", tokens).withColumn("backend", F.when(remote, "remote").otherwise("local"))
    over = (F.col("backend") == "local") & (F.col("tokens") + C.ANSWER_TOKENS > C.CONTEXT_TOKENS)
    return rows.withColumn("size_warning", F.when(over, F.format_string(f"Transcript is ~%,d tokens with the answer, over the local context of {C.CONTEXT_TOKENS:,}: the start of the meeting may be ignored.", F.col("tokens") + C.ANSWER_TOKENS)))


def parse_records(replies: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records, decisions, actions) of replies (meeting_id, reply, error, text): items without statement or task are left out,
    spellings of nothing become null, and a malformed reply gives an empty record with a warning."""
    rows = replies.withColumn("r", json_object(F.col("reply"), schemas.RECORD_JSON))
    decisions = rows.select(M, F.posexplode("r.decisions").alias("ordinal", "d")).select(M, "ordinal", F.coalesce(strip(F.col("d.statement")), F.lit("")).alias("statement"), F.coalesce(strip(F.col("d.evidence")), F.lit("")).alias("evidence")).where("statement <> ''")
    actions = rows.select(M, F.posexplode("r.action_items").alias("ordinal", "a")).select(M, "ordinal", F.coalesce(strip(F.col("a.task")), F.lit("")).alias("task"), clean_null(F.col("a.owner")).alias("owner"), clean_null(F.col("a.deadline")).alias("deadline"), F.coalesce(strip(F.col("a.evidence")), F.lit("")).alias("evidence")).where("task <> ''")
    minutes = F.filter(F.transform(F.coalesce("r.minutes", F.array().cast("array<string>")), strip), lambda m: m != "")
    none = (F.coalesce(F.size(F.filter("r.decisions", lambda d: strip(d["statement"]) != "")), F.lit(0)) <= 0) & (F.coalesce(F.size(F.filter("r.action_items", lambda a: strip(a["task"]) != "")), F.lit(0)) <= 0)
    long = F.when((F.size(white_tokens(F.col("text"))) > C.LONG_MEETING_WORDS) & none, "No decisions or action items were extracted from a long meeting. This usually means the model ran out of room, not that nothing was decided; re-run, or check the minutes.")
    failed = F.when(F.col("error").isNotNull() & F.col("reply").isNull(), F.concat(F.lit("Meeting-record model unavailable: "), F.col("error"))).when(F.col("r").isNull(), F.lit("The language model returned a malformed response."))
    warnings = F.array_compact(F.array(failed, long))
    records = rows.select(M, F.coalesce(strip(F.col("r.summary")), F.lit("")).alias("summary"), minutes.alias("minutes"), warnings.alias("warnings"))
    return records, decisions, actions


def parse_edits(replies: DataFrame) -> DataFrame:
    """EDITS of a correction model's replies; items without a segment point at segment -1, which the gates reject."""
    rows = replies.withColumn("r", json_object(F.col("reply"), schemas.EDITS_JSON)).select(M, F.posexplode("r.edits").alias("ordinal", "e"))
    return rows.select(M, "ordinal", F.coalesce("e.segment_id", F.lit(-1)).alias("segment_id"), F.coalesce("e.original", F.lit("")).alias("original"), F.coalesce("e.replacement", F.lit("")).alias("replacement"), F.left(F.coalesce("e.reason", F.lit("")), F.lit(200)).alias("reason"), F.coalesce("e.confidence", F.lit(0.0)).alias("confidence"), F.lit("llm").alias("source"))


def parse_verdicts(replies: DataFrame) -> DataFrame:
    """(meeting_id, ordinal, index, keep, why) of a reviewing model's replies; what it does not answer is kept."""
    rows = replies.withColumn("r", json_object(F.col("reply"), schemas.VERDICTS_JSON)).select(M, F.posexplode("r.verdicts").alias("ordinal", "v"))
    return rows.select(M, "ordinal", F.col("v.index").alias("index"), "v.keep", "v.why")


def as_text(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(""))
