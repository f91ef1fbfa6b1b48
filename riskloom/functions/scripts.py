"""Features of build scripts and files, as Column expressions in the JVM; byte entropy counts in numpy over Arrow buffers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Substrings that tell of network use, in their published order.
NETWORK_WORDS = (
    "reqwest", "hyper", "curl", "ureq", "attohttpc", "surf", "isahc", "minreq", "awc", "tokio::net",
    "std::net::TcpStream", "std::net::UdpSocket", "socket2", "mio", "download", "fetch", "wget", "http::", "https::",
)
#: Regular expressions of link directives and of process starts, and top-level domains that cost nothing.
LINK_PATTERN = r"#\[link\]|cargo:rustc-link-lib|cargo:rustc-link-search"
SPAWN_PATTERN = r"Command::new|process::Command|std::process::|\.exec\(|\.spawn\("
FREE_TLDS = ("tk", "ml", "ga", "cf", "gq", "xyz", "top", "work", "click", "link", "host")
IP_PATTERN = r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b"
#: First bytes (hex) of executables: ELF, five Mach-O forms, PE, WebAssembly.
EXECUTABLE_MAGIC = ("7F454C46", "CAFEBABE", "FEEDFACE", "FEEDFACF", "CFFAEDFE", "CEFAEDFE", "0061736D")
PE_MAGIC = "4D5A"
LIBRARY_ENDINGS = (".exe", ".dll", ".so", ".dylib")
#: What a source file's name ends in, and the largest size that is read.
SOURCE_EXTENSIONS = (
    "rs", "py", "js", "ts", "sh", "bash", "ps1", "bat", "cmd", "c", "cpp", "h", "hpp", "go", "java", "rb", "pl", "php",
    "toml", "yaml", "yml", "json", "xml", "Makefile", "Dockerfile",
)
MAX_SOURCE_BYTES = 8 << 20


def _false_if_null(x: Column) -> Column:
    return F.coalesce(x, F.lit(False))


def calls_network(text: Column) -> Column:
    out = F.lit(False)
    for word in NETWORK_WORDS:
        out = out | F.contains(text, F.lit(word))
    return _false_if_null(out)


def links_native(text: Column) -> Column:
    return _false_if_null(text.rlike(LINK_PATTERN))


def spawns_process(text: Column) -> Column:
    return _false_if_null(text.rlike(SPAWN_PATTERN))


def has_free_tld(text: Column) -> Column:
    return _false_if_null(text.rlike(rf"\.({'|'.join(FREE_TLDS)})\b"))


def is_public_ip(address: Column) -> Column:
    """Four octets of at most 255 outside the loopback, private, null and link-local ranges."""
    parts = F.transform(F.split(address, r"\."), lambda x: x.cast("int"))
    a, b = parts[0], parts[1]
    local = (a == 127) | (a == 10) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 0) & (b == 0)) | ((a == 169) & (b == 254))
    return F.forall(parts, lambda x: x <= 255) & ~local


def has_raw_ip(text: Column) -> Column:
    return _false_if_null(F.exists(F.regexp_extract_all(text, F.lit(IP_PATTERN), F.lit(0)), is_public_ip))


#: Bytes that are counted at once: numpy widens each to a word.
_COUNT_STEP = 1 << 20


def byte_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts, 256): how often each byte stands in data[offsets[i]:offsets[i + 1]]."""
    out = np.zeros((len(offsets) - 1, 256), np.int64)
    for row, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        for k in range(a, b, _COUNT_STEP):
            out[row] += np.bincount(data[k : min(k + _COUNT_STEP, b)], minlength=256)
    return out


def entropies(counts: np.ndarray) -> np.ndarray:
    """Of each row of counts, in bits; a row without any has 0."""
    total = np.maximum(counts.sum(axis=1, keepdims=True), 1)
    part = counts / total
    return -(part * np.log2(np.where(counts > 0, part, 1.0))).sum(axis=1) + 0.0


@F.arrow_udf(DoubleType())
def _byte_entropy(column: pa.Array) -> pa.Array:
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    if data is None or not len(column):
        return pa.array(np.zeros(len(column)))
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return pa.array(entropies(byte_counts(np.frombuffer(data, np.uint8), offsets)))


def byte_entropy(data: Column) -> Column:
    """Shannon entropy of a text's or binary's bytes, in bits; null and empty ones have 0. Bytes are counted in Arrow's own buffers."""
    return _byte_entropy(F.coalesce(data.cast("binary"), F.lit(b"")))


def has_executable_header(content: Column) -> Column:
    """Binary signatures; files under four bytes and scripts never count."""
    head = F.hex(F.substring(content, 1, 4))
    return _false_if_null((F.octet_length(content) >= 4) & (head.isin(*EXECUTABLE_MAGIC) | head.startswith(PE_MAGIC)))


def is_executable_candidate(path: Column, has_execute_bit: Column) -> Column:
    named = F.lit(False)
    for ending in LIBRARY_ENDINGS:
        named = named | path.endswith(ending)
    return (named | has_execute_bit) & ~F.concat(F.lit("/"), path).contains("/.git/")


def is_source_file(path: Column, size: Column) -> Column:
    """Eligible for review: known extension or build file, no hidden, target or node_modules folder, not too large."""
    name = F.element_at(F.split(path, "/"), -1)
    # A name that only starts with a dot has no extension.
    extension = F.regexp_extract(name, r"^.+\.([^.]+)$", 1)
    hidden = F.exists(F.split(path, "/"), lambda p: p.startswith(".") | p.isin("target", "node_modules"))
    return (extension.isin(*SOURCE_EXTENSIONS) | name.isin("Makefile", "Dockerfile")) & ~hidden & (size <= MAX_SOURCE_BYTES)


def clean_repository(x: Column) -> Column:
    return F.coalesce(F.trim(x), F.lit(""))


def clean_git_url(url: Column) -> Column:
    """Trimmed, one slash at the end dropped, cut before /tree/ and /blob/."""
    return F.substring_index(F.substring_index(F.regexp_replace(F.trim(url), "/$", ""), "/tree/", 1), "/blob/", 1)


#: What a failed clone says when a repository is private or gone.
CLONE_REFUSALS = ("repository not found", "could not read from remote repository", "access denied", "authentication failed", "permission denied", "fatal: repository")


def clone_was_refused(message: Column) -> Column:
    out = F.lit(False)
    for text in CLONE_REFUSALS:
        out = out | F.contains(F.lower(message), F.lit(text))
    return _false_if_null(out)


def parse_timestamp(x: Column) -> Column:
    """Zone-less timestamp of the text before the first '+'; null where it does not parse."""
    return F.try_to_timestamp(F.split_part(x, F.lit("+"), F.lit(1))).cast("timestamp_ntz")


def _fixed(x: Column, digits: int) -> Column:
    """A number with fixed digits, rounded by its exact binary value (format_string rounds the shortest decimal that reads back)."""
    return F.replace(F.format_number(x, digits), F.lit(","), F.lit(""))


def show_number(n: Column) -> Column:
    return F.when(n >= 1_000_000, F.concat(_fixed(n / 1e6, 1), F.lit("M"))).when(n >= 1_000, F.concat(_fixed(n / 1e3, 1), F.lit("K"))).otherwise(n.cast("string"))


def show_duration(ms: Column) -> Column:
    return F.when(ms.isNull(), "—").when(ms >= 1000, F.concat(_fixed(ms / 1000.0, 1), F.lit("s"))).otherwise(F.concat(_fixed(ms.cast("double"), 0), F.lit("ms")))


def risk_label(score: Column) -> Column:
    """low to 30, medium to 60, high to 80; all else, the failed-scan mark too, is critical."""
    return F.when(score.between(0, 30), "low").when(score.between(31, 60), "medium").when(score.between(61, 80), "high").otherwise("critical")
