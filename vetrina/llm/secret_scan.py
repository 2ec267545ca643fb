"""Secret scans: three fixed patterns, then strings in sensitive places that a primed compressor cannot shorten.

A candidate is a run of letters, digits and ``+/_-`` (and ``=`` at its end) that begins shortly after a word such as
``token`` or ``passwd``, has characters of two kinds (lower case, upper case beyond the first, digits), and is not part of a fixed match. Its
novelty is the number of bytes that it adds to the compressed text before it, by zstandard primed with a dictionary, for
each byte of its own. Names, paths and placeholders repeat what stands around them or what the dictionary has; a random
string does not. Each distinct candidate of a text is measured where it first occurs, and the verdict holds for all its
sensitive places, since a repeated secret would else hide itself.

The dictionary has the parts of identifiers (runs of letters of one case, or with a capital) that stand around sensitive
words in most documents, counted over whole texts of all documents, behind a short list of fixed words. Its parts are
short and of letters only, so that a secret that was copied a thousand times does not become a word. Counts are added up
in tasks before they are dealt, and only the first ``PARTS`` reach the driver.

Spans are in code points, the end exclusive, kinds in the order assign, access, hex, novel.

Defined cases: a null or empty text has no spans; texts of any length are read as a whole; a null doc_id is a document
like any other; repeated rows are judged row by row; an empty table gives an empty result; extra columns are not read.
Letters count as such in ASCII alone.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vetrina.llm import common

#: The fixed patterns and the least length of what they find (of its second group for ``assign``).
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 8, 16, 32
KINDS = ["assign", "access", "hex", "novel"]
#: Words that make what follows them sensitive.
SENSITIVE = r"passw(?:or)?d|passphrase|pwd|secret|token|api_?key|access_?key|private_?key|client_?key|account_?key|credential|authorization|bearer|signature"
#: How far behind such a word a candidate may begin, its least length, and the text before it that it is measured with.
REACH, LEAST, BEFORE = 64, 16, 256
#: Bytes added for each byte of its own, at least, for a candidate to be reported.
NOVEL = 0.8
#: Parts of identifiers in the dictionary, at most, the documents that must have one, and the compressor's level.
PARTS, PART_DOCUMENTS, LEVEL = 4096, 3, 9
#: Counts that a task holds at once.
HELD = 100_000
#: Fixed words, in the dictionary before any that were counted.
WORDS = (
    "abstract access account address admin alphabet application array async auth authorization await base64 basic bearer boolean bucket bytes cache "
    "certificate class client config connection console const content context cookie credential database debug default delete description development "
    "digest docs document domain email enabled encoding endpoint environment error example export false file final float format function generic getting "
    "hash header home host http https identifier image import include index input instance integer interface internal issuer json label language length "
    "library local localhost login master message method model module name namespace network none null number object option output package parameter "
    "password path placeholder policy port private process production profile project property protected provider proxy public query random read redirect "
    "refresh region register remote request reset resource response result return role root sample schema scheme scope script secret secure server service "
    "session settings signature source staging start state static status storage store stream string struct sudo system table target template temporary test "
    "timeout title token true type undefined update upload user username utils value variable vector verify version void webhook worker write your"
).split()

_ASSIGN = re.compile(ASSIGN, re.IGNORECASE | re.ASCII)
# Equal to the runs of one sign or more that are long enough: no shorter run holds a longer one.
_ACCESS = re.compile(rf"AKIA[A-Z0-9]{{{ACCESS_LEAST - 4},}}")
_HEX = re.compile(rf"[0-9a-f]{{{HEX_LEAST},}}")
_SENSITIVE = re.compile(SENSITIVE, re.IGNORECASE | re.ASCII)
_RUN = re.compile(r"[A-Za-z0-9+/_-]+={0,2}")
#: What is left of the identifier that a sensitive word stands in.
_REST = re.compile(r"[A-Za-z0-9_-]*")
_PART = re.compile(r"[A-Z][a-z]{2,11}|[a-z]{3,12}|[A-Z]{3,12}")
#: Lower-case bytes of which a text must have some, for one of the patterns with words to find anything.
_NEEDED = [b"passw", b"passphrase", b"pwd", b"secret", b"token", b"apikey", b"api_key", b"ccesskey", b"ccess_key", b"privatekey", b"private_key", b"clientkey", b"client_key", b"accountkey", b"account_key", b"credential", b"authorization", b"bearer", b"signature"]

Span = tuple[int, int, int]


def _has_words(text: str) -> bool:
    low = text.encode("utf-8", "surrogatepass").lower()  # of bytes: ASCII letters alone
    return any(w in low for w in _NEEDED)


def base_spans(text: str, has_words: bool) -> list[Span]:
    """(start, kind, end) of what the fixed patterns find, in order."""
    found = [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)] + [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    if has_words:
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    return sorted(found)


def _is_mixed(run: str) -> bool:
    kinds = (any(c.isdigit() for c in run), any("a" <= c <= "z" for c in run), any("A" <= c <= "Z" for c in run[1:]))
    return sum(kinds) >= 2


def candidates(text: str, taken: list[Span]) -> Iterator[tuple[int, int]]:
    """(start, end) of the runs in sensitive places that no fixed match touches, in order."""
    at, k = 0, 0
    for word in _SENSITIVE.finditer(text):
        stop = word.end() + REACH
        place = max(at, _REST.match(text, word.end()).end())
        while (run := _RUN.search(text, place)) and run.start() < stop:
            place = at = run.end()
            while k < len(taken) and taken[k][2] <= run.start():
                k += 1
            touched = k < len(taken) and taken[k][0] < run.end()
            if run.end() - run.start() >= LEAST and not touched and _is_mixed(run[0]):
                yield run.span()


def part_counts(texts: list[str], into: Counter) -> None:
    """Count the parts of identifiers around sensitive words, each once a text."""
    for text in texts:
        if not _has_words(text):
            continue
        seen: set[str] = set()
        done = 0
        for word in _SENSITIVE.finditer(text):
            begin, end = max(done, word.start() - BEFORE), min(len(text), word.end() + BEFORE)
            if begin < end:
                seen.update(p.lower() for p in _PART.findall(text, begin, end))
                done = end
        into.update(seen)


def dictionary(docs: DataFrame) -> bytes:
    """The dictionary's text: counted parts, the most common last, after the fixed words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["part", "n"])
            held.clear()
            return out

        for b in batches:
            part_counts(b.column("text").to_pylist(), held)
            if len(held) > HELD:
                yield flush()
        yield flush()

    parts = docs.select("text").where("text is not null").mapInArrow(count, "part string, n long")
    first = parts.groupBy("part").agg(F.sum("n").alias("n")).where(F.col("n") >= PART_DOCUMENTS).orderBy(F.desc("n"), "part").limit(PARTS).collect()
    return " ".join([*WORDS, *(r.part for r in reversed(first))]).encode()


class Novelty:
    """How many bytes a string adds to the compressed text before it, by a dictionary-primed compressor."""

    def __init__(self, words: bytes):
        primed = zstandard.ZstdCompressionDict(words, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        primed.precompute_compress(level=LEVEL)
        self.compressor = zstandard.ZstdCompressor(dict_data=primed, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)

    def added(self, before: str, own: str) -> int:
        context = before.encode("utf-8", "surrogatepass")
        return len(self.compressor.compress(context + own.encode())) - len(self.compressor.compress(context))

    def novel(self, text: str, taken: list[Span]) -> list[Span]:
        """(start, kind, end) of the candidates that are reported."""
        verdicts: dict[str, bool] = {}
        out = []
        for start, end in candidates(text, taken):
            own = text[start:end]
            if own not in verdicts:
                verdicts[own] = self.added(text[max(0, start - BEFORE) : start], own) >= NOVEL * len(own)
            if verdicts[own]:
                out.append((start, 3, end))
        return out


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, words: bytes | None = None) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_novel.

    ``words`` is the dictionary's text; where it is not given, it is counted over ``docs``.
    """
    words = dictionary(docs) if words is None else words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(words)
        for b in batches:
            counts: list[list[int]] = [[], [], [], []]
            digests, spans = [], []
            for text in b.column("text").to_pylist():
                has_words = _has_words(text)
                base = base_spans(text, has_words)
                more = novelty.novel(text, base) if has_words else []
                for k, c in enumerate(counts):
                    c.append(sum(kind == k for _, kind, _ in (base if k < 3 else more)))
                digests.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                spans.append(_joined(sorted([*base, *more])))
            named = dict(zip(("n_assign", "n_access", "n_hex", "n_novel"), counts, strict=True))
            columns = [b.column("doc_id"), *(pa.array(named[c], pa.int64()) for c in ("n_assign", "n_access", "n_hex")), pa.array(digests, pa.string()), pa.array(spans, pa.string()), pa.array(named["n_novel"], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_novel"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_novel long")


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.table(spark, sf_dir, "documents"))
