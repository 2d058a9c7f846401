"""Secrets in texts: fixed patterns, and strings that a tokenizer cannot compress.

The vocabulary of a byte-pair tokenizer holds what people write often.  Words and
names come out at several characters a token, keys and passwords at hardly more
than one.  So a long run of key characters with few characters per token is
taken for random.  Digests, UUIDs, numbers and identifiers made of words are
random-looking but no secrets, and are left out; a key among them is found by itself.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from larder.llm.files import kept
from larder.llm.tables import texts

# The patterns of the base kinds.
ASSIGN = re.compile(
    r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    re.IGNORECASE | re.ASCII)
ASSIGN_LENGTH = 12
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "random")

RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
UUID = re.compile(r"[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}", re.IGNORECASE)
INTEGRITY = re.compile(r"sha(?:256|384|512)-[A-Za-z0-9+/]+={0,2}")
HEX_DIGEST = re.compile(r"[0-9A-Fa-f]+")
DIGEST_LENGTHS = {32, 40, 48, 56, 64, 96, 128}
PART = re.compile(r"[A-Za-z0-9]+")
LEAST = 20  # characters of a random span
SHORT = 3  # characters of a part that tells nothing by itself
LIMIT = 2.0  # characters a token


def encoding(path: str) -> tiktoken.Encoding:
    """The tiktoken encoding of a rank file; runs have no spaces, so no pattern matters."""
    def load():
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        return tiktoken.Encoding("ranks", pat_str=r"\S+|\s+", mergeable_ranks=ranks,
                                 special_tokens={})

    return kept(("ranks", path), load)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Start, end and kind of the matches of the fixed patterns."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text)
                  if m.end(1) - m.start(1) >= ASSIGN_LENGTH]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def is_known(run: str) -> bool:
    """Whether ``run`` is a digest, an identifier or a number rather than a secret."""
    if run.isdigit() or UUID.fullmatch(run) or INTEGRITY.fullmatch(run):
        return True
    if HEX_DIGEST.fullmatch(run) and len(run) in DIGEST_LENGTHS:
        return True
    return False


def is_name(part: str, encode: tiktoken.Encoding, limit: float) -> bool:
    """Whether ``part`` is a number, or made of words that the vocabulary holds."""
    return part.isdigit() or is_known(part) or len(part) > limit * len(encode.encode_ordinary(part))


def free(start: int, end: int, taken: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """What the ``taken`` spans leave of a run."""
    left = []
    for low, high, _ in taken:  # by start
        if low < end and high > start:
            left.append((start, low))
            start = max(start, high)
    return [(a, b) for a, b in [*left, (start, end)] if b - a >= LEAST]


def random_spans(text: str, taken: list[tuple[int, int, str]], encode: tiktoken.Encoding,
                 limit: float) -> list[tuple[int, int, str]]:
    """Runs outside the ``taken`` spans that need a token for ``limit`` characters or fewer.

    Where a run as a whole needs fewer tokens, its parts that are no names are
    tested, neighbours together.
    """
    def is_random(run: str) -> bool:
        return (len(run) >= LEAST and not is_known(run)
                and len(run) <= limit * len(encode.encode_ordinary(run)))

    found = []
    for match in RUN.finditer(text):
        if is_known(match.group()):
            continue
        for start, end in free(*match.span(), taken):
            fixed = [m.span() for form in (UUID, INTEGRITY) for m in form.finditer(text, start, end)]
            stretches: list[list[tuple[int, int]]] = [[]]
            named = False
            for part in PART.finditer(text, start, end):
                low, high = part.span()
                if any(a <= low and high <= b for a, b in fixed) or is_name(
                        part.group(), encode, limit):
                    named = named or high - low > SHORT
                    stretches.append([])
                elif high - low > SHORT or stretches[-1]:
                    stretches[-1].append((low, high))
            if not any(high - low > SHORT for s in stretches for low, high in s):
                continue  # a name
            if not named and is_random(text[start:end]):
                found.append((start, end, "random"))
                continue
            spans = [(s[0][0], s[-1][1]) for s in stretches if s]
            some = [(a, b, "random") for a, b in spans if is_random(text[a:b])]
            if not some and is_random(text[start:end]):
                some = [(start, end, "random")]
            found += some
    return found


def spell(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def find_secrets(docs: DataFrame, ranks: str, limit: float = LIMIT) -> DataFrame:
    """Secrets of every text of ``docs`` (doc_id, text).

    ``ranks`` is the rank file of a tiktoken vocabulary.  Returns one row per row
    of ``docs``: doc_id, the numbers of spans by kind (n_assign, n_access, n_hex,
    n_random), base_sha256 (of the spans of the first three kinds) and spans, all
    of them as kind:start:end in code points, by start and kind, joined by
    commas.  Base spans may overlap each other; a random span overlaps none.

    Null and empty texts have no spans.  Repeated rows and null ids come out as
    they are; of an empty table the result is empty.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(ranks)
        for batch in batches:
            rows = {k: [] for k in (*(f"n_{k}" for k in KINDS), "base_sha256", "spans")}
            for text in batch.column("text"):
                text = text.as_py() or ""
                base = base_spans(text)
                every = sorted(base + random_spans(text, base, encode, limit),
                               key=lambda s: (s[0], KINDS.index(s[2])))
                for kind in KINDS:
                    rows[f"n_{kind}"].append(sum(s[2] == kind for s in every))
                rows["base_sha256"].append(hashlib.sha256(spell(base).encode()).hexdigest())
                rows["spans"].append(spell(every))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id")} | {
                k: pa.array(v, pa.int64() if k[:2] == "n_" else pa.string())
                for k, v in rows.items()})

    return texts(docs).mapInArrow(run, "doc_id long, " + ", ".join(
        f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string")
