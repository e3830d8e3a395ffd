"""File sources. Every reader has an explicit schema; a file's meeting is its name without folder and ending."""

from __future__ import annotations

import io
import wave
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.functions.text import strip
from parlance.operators.refine import glossary

WORD = T.StructType([T.StructField("word", T.StringType()), T.StructField("start", T.DoubleType()), T.StructField("end", T.DoubleType()), T.StructField("probability", T.DoubleType()), T.StructField("speaker", T.StringType())])
SEGMENT = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("start", T.DoubleType()), T.StructField("end", T.DoubleType()), T.StructField("text", T.StringType()), T.StructField("avg_logprob", T.DoubleType()), T.StructField("no_speech_prob", T.DoubleType()), T.StructField("compression_ratio", T.DoubleType()), T.StructField("words", T.ArrayType(WORD))])
TRANSCRIPT = T.StructType([T.StructField("meeting_id", T.StringType()), T.StructField("language", T.StringType()), T.StructField("duration", T.DoubleType()), T.StructField("model", T.StringType()), T.StructField("processing_seconds", T.DoubleType()), T.StructField("segments", T.ArrayType(SEGMENT))])
LINE = "array<struct<speaker:string,text:string,spoken:string>>"
SCRIPT = f"title string, rate int, lines {LINE}, ground_truth struct<decisions:array<struct<statement:string,must_appear:boolean,scored:boolean,evidence:string>>,action_items:array<struct<task:string,owner:string,deadline:string>>,must_preserve:struct<numbers:array<string>,negation:string>,domain_terms:array<string>,injections:struct<corruptions:map<string,string>,negative_control:struct<term:string,corruption:string>>,spoken_variants:map<string,string>>"


def file_stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]+)$", 1), r"\.[^.]*$", "")


def read_transcripts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(meetings, segments, words) of JSON transcripts, a document for each file."""
    rows = spark.read.schema(TRANSCRIPT).json(path, multiLine=True).withColumn("meeting_id", F.coalesce("meeting_id", file_stem(F.input_file_name())))
    segments = rows.select("meeting_id", F.explode("segments").alias("s"))
    words = segments.select("meeting_id", F.col("s.id").alias("segment_id"), F.posexplode("s.words").alias("word_idx", "w"))
    words = words.select("meeting_id", "segment_id", "word_idx", "w.word", "w.start", "w.end", "w.probability", "w.speaker")
    segments = segments.select("meeting_id", F.col("s.id").alias("segment_id"), "s.start", "s.end", "s.text", "s.avg_logprob", "s.no_speech_prob", "s.compression_ratio")
    return rows.drop("segments"), segments, words


def read_glossary(spark: SparkSession, path: str) -> DataFrame:
    """Terms of a JSON list of strings, or of an object with `terms`."""
    text = spark.read.text(path, wholetext=True).withColumn("value", strip(F.col("value")))
    terms = F.coalesce(F.when(F.col("value").startswith("["), F.from_json("value", "array<string>")), F.from_json("value", "terms array<string>")["terms"])
    return glossary(text.select(F.posexplode(terms).alias("ordinal", "term")))


def read_rttm(spark: SparkSession, path: str) -> DataFrame:
    """(meeting_id, ordinal, start, end, speaker) of lines of eight fields and more that begin with SPEAKER."""
    rows = spark.read.text(path, wholetext=True).select(file_stem(F.input_file_name()).alias("meeting_id"), F.posexplode(F.split("value", "\n")).alias("ordinal", "line"))
    p = F.split(strip(F.col("line")), r"\s+")
    rows = rows.where((F.size(p) >= 8) & (p[0] == "SPEAKER"))
    start = F.try_element_at(p, F.lit(4)).try_cast("double")
    return rows.select("meeting_id", "ordinal", start.alias("start"), (start + F.try_element_at(p, F.lit(5)).try_cast("double")).alias("end"), F.try_element_at(p, F.lit(8)).alias("speaker"))


def read_scripts(spark: SparkSession, path: str) -> DataFrame:
    """Scripts with their answer keys, as nested columns."""
    return spark.read.schema(SCRIPT).json(path, multiLine=True).withColumn("meeting_id", file_stem(F.input_file_name()))


MARK = r"\{\{([^|}]*)\|([^}]*)\}\}"


def marked_lines(lines: DataFrame) -> DataFrame:
    """`Speaker: text` lines with {{meant|spoken}}: speaker, meant and spoken text, and variants (meant -> spoken)."""
    value = strip(F.col("value"))
    rows = lines.where(value.rlike(r"^[^:#{]+:\s*\S")).withColumn("speaker", strip(F.regexp_extract(value, r"^([^:]+):", 1))).withColumn("body", strip(F.regexp_replace(value, r"^[^:]+:\s*", "")))
    meant, spoken = F.regexp_extract_all("body", F.lit(MARK), F.lit(1)), F.regexp_extract_all("body", F.lit(MARK), F.lit(2))
    return rows.withColumn("text", F.regexp_replace("body", MARK, "$1")).withColumn("spoken", F.regexp_replace("body", MARK, "$2")).withColumn("variants", F.arrays_zip(meant.alias("meant"), spoken.alias("spoken"))).drop("body")


def read_marked_script(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.text(path, wholetext=True).select(file_stem(F.input_file_name()).alias("meeting_id"), F.posexplode(F.split("value", "\n")).alias("ordinal", "value"))
    return marked_lines(rows)


# --- audio ---

Decoder = Callable[[bytes], np.ndarray]


def decode_wav(data: bytes) -> np.ndarray:
    """Mono float32 of a PCM WAV file of 16 bits."""
    with wave.open(io.BytesIO(data)) as w:
        if w.getsampwidth() != 2:
            raise ValueError(f"{8 * w.getsampwidth()}-bit samples are not supported")
        x = np.frombuffer(w.readframes(w.getnframes()), dtype="<i2").astype(np.float32) / 32768
        x = x.reshape(-1, w.getnchannels()).mean(axis=1)
        if w.getframerate() != 16_000 and len(x):
            at = np.arange(0, len(x), w.getframerate() / 16_000)
            x = np.interp(at, np.arange(len(x)), x).astype(np.float32)
        return x


def empty_files(spark: SparkSession, path: str) -> list[str]:
    """Files of no bytes at a path, pattern or folder: Spark's reader leaves them out, so they are listed here."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    where = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [x for s in (where.globStatus(at) or []) for x in (where.listStatus(s.getPath()) if s.isDirectory() else [s])]
    return [x.getPath().toString() for x in found if x.isFile() and x.getLen() == 0]


AUDIO = "path string, length long, samples int, duration double, rms double, method string, error string, warnings array<string>"
SHORT_S, QUIET_RMS = 1.0, 1e-4  # fixed values


def read_audio(spark: SparkSession, path: str, decoders: tuple[tuple[str, Decoder], ...] = (("wave", decode_wav),), payload: bool = False) -> DataFrame:
    """A row for each file: the first decoder with samples wins, else `error` lists the attempts; soft warnings for short and
    quiet audio. Samples stay one value of a file (`payload`), never rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for p, n, data in zip(pdf["path"], pdf["length"], pdf["content"], strict=True):
                x, method, tried = None, None, []
                if not n:
                    tried.append("the file is empty")
                else:
                    for name, decode in decoders:
                        try:
                            got = decode(data)
                            if len(got):
                                x, method = got, name
                                break
                            tried.append(f"{name}: no samples")
                        except Exception as e:  # noqa: BLE001 - any decoder error is one attempt
                            tried.append(f"{name}: {e or type(e).__name__}")
                seconds = len(x) / 16_000 if x is not None else None
                rms = float(np.sqrt(np.mean(np.square(x, dtype=np.float64)))) if x is not None else None
                notes = [] if x is None else [t for bad, t in ((seconds < SHORT_S, f"The recording is very short ({seconds:.2f} s)."), (rms < QUIET_RMS, "The recording is nearly silent.")) if bad]
                row = (p, n, len(x) if x is not None else None, seconds, rms, method, None if x is not None else "; ".join(tried), notes)
                out.append((*row, x.tobytes()) if payload and x is not None else (*row, None) if payload else row)
            names = [c.split()[0] for c in schema.split(", ")]
            yield pd.DataFrame(out, columns=names).astype({"samples": "Int32"})

    schema = AUDIO + (", pcm binary" if payload else "")
    rows = spark.read.format("binaryFile").load(path).select("path", "length", "content").mapInPandas(run, schema)
    empty = [(p, 0, "the file is empty") for p in empty_files(spark, path)]
    return rows.unionByName(spark.createDataFrame(empty, "path string, length long, error string"), allowMissingColumns=True) if empty else rows


def read_cached(spark: SparkSession, cache: str, files: DataFrame, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Results by (path, length, modificationTime): those in the cache, and the rest computed and added to it."""
    key = ["path", "length", "modificationTime"]
    try:
        have = spark.read.parquet(cache)
    except Exception:  # noqa: BLE001 - no cache yet
        have = None
    todo = files if have is None else files.join(have.select(*key), key, "left_anti")
    compute(todo).write.mode("append").parquet(cache)
    return spark.read.parquet(cache).join(files.select(*key), key, "left_semi")
