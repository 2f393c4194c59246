"""WARC derivatives: for each response record, a metadata and a conversion record that refer to it.

The metadata record holds what was found in the page (title, language, outlinks; application/warc-fields); the
conversion record its plain text. Both keep the response's target URI, date and the digest of its payload, name it in
WARC-Refers-To, and have digests of their own blocks. Record ids are made from the response's id and the kind of
derivative, so a repeated run writes the same records. Each record depends on one response only: no shuffle.
"""

from __future__ import annotations

import base64
import hashlib
import html
import io
import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm._common import others

#: Where a tag, a comment or a declaration may begin.
_OPEN = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/>]*))")
_HREF = re.compile(r"(?<![\w-])href\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_LANG = re.compile(r"\blang\s*=\s*[\"']?([\w-]+)", re.I)
_BLANKS = re.compile(r"[ \t\x0b\x0c\r\xa0]+")
#: Elements whose content is no text; those whose content runs to the end of the page if they are not closed.
_HIDDEN, _TO_END = {"script", "style", "noscript", "template"}, {"script", "style"}
_CLOSE = {n: re.compile(rf"</{n}\s*>", re.I) for n in (*_HIDDEN, "title")}
_BLOCKS = set("p div br li ul ol h1 h2 h3 h4 h5 h6 tr table section article nav header footer blockquote pre title hr dd dt dl aside main form figure".split())
#: Any other element ends a head that is not closed.
_IN_HEAD = {"head", "base", "basefont", "bgsound", "link", "meta", "title", *_HIDDEN}
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:gristmill:warc")


class Page:
    """One pass over a page: title and language (None if there is none), outlinks, and text.

    Comments, scripts, styles, templates and the head are no text; block elements end lines; entities are characters.
    The time is linear in the length of any page: a tag that isn't closed ends the search for tags, and what has no end
    tag is looked for once.
    """

    def __init__(self, page: str):
        self.title = self.language = None
        self.links: list[str] = []
        parts: list[str] = []
        unclosed: set[str] = set()
        at, in_head = 0, False
        while m := _OPEN.search(page, at):
            if not in_head:
                parts.append(page[at : m.start()])
            if m[1]:  # a comment
                end = page.find("-->", m.end())
                at = len(page) if end < 0 else end + 3
                parts.append(" ")
                continue
            end = page.find(">", m.end())
            if end < 0:  # no tag ends any more: the rest is text
                at = m.start()
                break
            tag, at = page[m.start() : end + 1], end + 1
            if m[2]:
                continue
            name, closing = m[4].lower(), bool(m[3])
            if in_head and (closing and name == "head" or not closing and name not in _IN_HEAD):
                in_head = False
                if closing:
                    continue
            if closing:
                if name in _BLOCKS and not in_head:
                    parts.append("\n")
                continue
            if name in _CLOSE and name not in unclosed:
                close = _CLOSE[name].search(page, at)
                if close is None and name not in _TO_END:
                    unclosed.add(name)
                elif name in _HIDDEN:
                    at = len(page) if close is None else close.end()
                    parts.append(" ")
                    continue
                elif self.title is None:
                    self.title = page[at : close.start()]
            if name == "head":
                in_head = True
                parts.append(" ")
            elif name == "html" and self.language is None and (found := _LANG.search(tag)):
                self.language = found[1]
            elif name == "a" and (found := _HREF.search(tag)):
                self.links.append(found[1] or found[2] or found[3] or "")
            if name in _BLOCKS and not in_head:
                parts.append("\n")
        if not in_head:
            parts.append(page[at:])
        lines = _BLANKS.sub(" ", html.unescape("".join(parts))).split("\n")
        self.text = "\n".join(x for x in (line.strip() for line in lines) if x)

    def fields(self) -> str:
        """The block of the metadata record."""
        flat = lambda x: " ".join(html.unescape(x).split())
        rows = [] if self.title is None else [("title", flat(_bare(self.title)))]
        if self.language:
            rows.append(("language", self.language))
        rows += [("outlink", f"{flat(link)} L a/@href") for link in self.links]
        return "".join(f"{k}: {v}\r\n" for k, v in rows)


def _bare(text: str) -> str:
    """Without tags, in one pass."""
    out, at = [], 0
    while m := _OPEN.search(text, at):
        end = text.find(">", m.end())
        if end < 0:
            break
        out.append(text[at : m.start()])
        at = end + 1
    return "".join([*out, text[at:]])


def plain_text(page: str) -> str:
    return Page(page).text


def fields_of(page: str) -> str:
    return Page(page).fields()


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, chr(0).join(parts))}>"


def header_value(value: str) -> str:
    """A header's value on one line."""
    return " ".join(value.split("\r\n")).replace("\r", " ").replace("\n", " ").strip()


def header_uri(uri: str) -> str:
    """A URI without blanks and control characters: they are percent-encoded, so none can end a header line."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", uri.strip())


def record(kind: str, id_: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One WARC/1.1 record with its two line breaks at the end."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {id_}", *(f"{k}: {header_value(v)}" for k, v in headers), f"WARC-Block-Digest: {digest(block)}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


_NEXT = re.compile(rb"(?:\A|\r?\n)(WARC/\d\.\d\r?\n)")


class Reader:
    """Records of a WARC stream one after another, with no more of it held than a record and a buffer.

    read(n) gives up to n bytes, b"" at the end. next() gives (headers in lower case, block, None), or (headers, b"",
    problem) for what is no whole record; reading goes on at the next line that begins a record. None at the end.
    """

    def __init__(self, read: Callable[[int], bytes], buffer: int = 1 << 20):
        self.read, self.size, self.held, self.over = read, buffer, b"", False

    def _fill(self, n: int) -> bool:
        """Whether n bytes are held."""
        parts, have = [self.held], len(self.held)
        while have < n and not self.over:
            more = self.read(max(self.size, n - have))
            self.over = not more
            parts.append(more)
            have += len(more)
        self.held = b"".join(parts)
        return have >= n

    def _find(self, mark: bytes) -> int:
        at = 0
        while (end := self.held.find(mark, at)) < 0 and not self.over:
            at = max(0, len(self.held) - len(mark))
            self._fill(len(self.held) + self.size)
        return end

    def _resume(self, begin: int) -> None:
        """Drops what is held up to the next record that begins at `begin` or later."""
        self.held = self.held[begin:]
        while not (m := _NEXT.search(self.held)) and not self.over:
            self.held = self.held[-16:]
            self._fill(len(self.held) + self.size)
        self.held = self.held[m.start(1) :] if m else b""

    def next(self) -> tuple[dict[str, str], bytes, str | None] | None:
        while True:
            self.held = self.held.lstrip(b"\r\n")
            if self.held or not self._fill(1):
                break
        if not self.held:
            return None
        end = self._find(b"\r\n\r\n")
        if not self.held.startswith(b"WARC/") or end < 0:
            self._resume(1)
            return {}, b"", "no record header"
        lines = self.held[:end].decode("utf-8", "replace").split("\r\n")
        headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
        size = headers.get("content-length", "")
        if not (size.isascii() and size.isdigit()):
            self._resume(end + 2)
            return headers, b"", "no valid Content-Length"
        begin, length = end + 4, int(size)
        if not self._fill(begin + length):
            self._resume(begin)
            return headers, b"", "shorter than its Content-Length"
        block = self.held[begin : begin + length]
        self.held = self.held[begin + length :]
        return headers, block, None

    def __iter__(self) -> Iterator[tuple[dict[str, str], bytes, str | None]]:
        while (found := self.next()) is not None:
            yield found


_GZIP = b"\x1f\x8b\x08"


class Unzipped:
    """read() of a file that may be made of gzip members. A broken member is counted in `broken`; reading goes on at the next one."""

    def __init__(self, read: Callable[[int], bytes], buffer: int = 1 << 16):
        self.read, self.size, self.broken, self.member = read, buffer, 0, None
        self.raw = read(buffer)
        self.zipped = self.raw.startswith(_GZIP[:2])

    def __call__(self, n: int) -> bytes:
        if not self.zipped:
            out, self.raw = self.raw, b""
            return out or self.read(n)
        while self.raw or self._more():
            if self.member is None:
                if not self._begin():
                    return b""
                self.member = zlib.decompressobj(31)
            try:
                out = self.member.decompress(self.raw, n)
                ended, rest = self.member.eof, self.member.unused_data if self.member.eof else self.member.unconsumed_tail
            except zlib.error:
                out, ended, rest = b"", True, self.raw[1:]
                self.broken += 1
            self.raw, self.member = rest, None if ended else self.member
            if out:
                return out
        if self.member is not None:  # the file ends within a member
            out, self.member = self.member.flush(), None
            self.broken += 1
            return out
        return b""

    def _more(self) -> bool:
        self.raw = self.read(self.size)
        return bool(self.raw)

    def _begin(self) -> bool:
        """Drops what is held up to the next member; False if there is none."""
        skipped = False
        while True:
            at = self.raw.find(_GZIP)
            skipped |= at > 0
            if at >= 0:
                self.raw = self.raw[at:]
                break
            tail = self.raw[-2:]
            if not self._more():
                skipped |= bool(tail)
                break
            self.raw = tail + self.raw
        self.broken += skipped and not self.broken
        return at >= 0


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers in lower case, block) of each whole record of an uncompressed WARC file."""
    for headers, block, problem in Reader(io.BytesIO(data).read):
        if problem is None:
            yield headers, block


def decoded_body(head: str, body: bytes) -> str:
    """The text of an HTTP body: transfer chunks joined, content decompressed, decoded by the charset that the header or the page names (else UTF-8)."""
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.split("\r\n")[1:])}
    if "chunked" in fields.get("transfer-encoding", "").lower():
        body = _unchunked(body)
    coding = fields.get("content-encoding", "").lower()
    if coding in ("gzip", "x-gzip", "deflate"):
        for bits in (47, -15):
            try:
                body = zlib.decompressobj(bits).decompress(body)
                break
            except zlib.error:
                continue
    named = re.search(r"charset\s*=\s*[\"']?([\w.:-]+)", fields.get("content-type", ""), re.I) or re.search(rb"<meta[^>]{0,200}?charset\s*=\s*[\"']?([\w.:-]+)", body[:4096], re.I)
    name = "utf-8" if named is None else named[1] if isinstance(named[1], str) else named[1].decode("ascii", "replace")
    try:
        return body.decode(name, "replace")
    except LookupError:
        return body.decode("utf-8", "replace")


def _unchunked(body: bytes) -> bytes:
    """Transfer chunks joined; a body that isn't made of them stays as it is."""
    out, at = [], 0
    while (end := body.find(b"\r\n", at)) >= 0:
        try:
            size = int(body[at:end].split(b";")[0], 16)
        except ValueError:
            return body if not out else b"".join(out)
        if size <= 0:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + size])
        at = end + 4 + size
    return b"".join(out) if out else body


RESPONSE = "record_id string, target_uri string, date string, http_headers string, payload string, payload_digest string, problem string"


def read_responses(files: DataFrame) -> DataFrame:
    """Responses of WARC files, gzip members or not, as rows for derive(); of what is no whole record a row with `problem` and no payload.

    files has `content` (Spark's binaryFile), or only `path`: then each file is opened where its task runs (by pyarrow's
    file systems) and read record by record, whatever its size.
    """
    whole = "content" in files.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RESPONSE.split(", ")]
        for batch in batches:
            for given in batch.column(0).to_pylist():
                with io.BytesIO(given) if whole else _opened(given) as stream:
                    out: list[tuple] = []
                    held = 0
                    unzipped = Unzipped(stream.read)
                    for h, block, problem in Reader(unzipped):
                        if problem is None and h.get("warc-type") != "response":
                            continue
                        top = (h.get("warc-record-id"), h.get("warc-target-uri"), h.get("warc-date"))
                        if problem is not None:
                            out.append((*top, None, None, None, problem))
                            continue
                        head, _, body = block.partition(b"\r\n\r\n")
                        head = head.decode("latin-1")
                        out.append((*top, head, decoded_body(head, body), h.get("warc-payload-digest") or digest(body), None))
                        held += len(block)
                        if held > 1 << 24:
                            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*out, strict=True)], names)
                            out, held = [], 0
                    if unzipped.broken:
                        out.append((*[None] * 6, "broken gzip member"))
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*out, strict=True)], names)

    return files.select("content" if whole else "path").mapInArrow(run, RESPONSE)


def _opened(path: str):
    from pyarrow import fs

    system, where = fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)
    return system.open_input_stream(where, compression=None)


def responses_of_pages(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """The pages table as responses: page_id, and what derive() needs. The date is a parameter: pages have none."""
    size = F.octet_length(F.coalesce("html", F.lit("")))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size.cast("string"))
    return pages.select("page_id", F.lit(None).cast("string").alias("record_id"), F.col("url").alias("target_uri"), F.lit(date).alias("date"), head.alias("http_headers"), F.col("html").alias("payload"), F.lit(None).cast("string").alias("payload_digest"))


def derive(responses: DataFrame, keep: list[str] | None = None, records: bool = True) -> DataFrame:
    """Two rows for each response: the columns `keep` (default: those that are none of the response's own), kind
    (metadata or conversion), record_id, refers_to, target_uri, source_headers, source_digest, block_digest, block_length, block, and record (the whole record; null without records).

    A null payload counts as empty: empty blocks. Without a record_id one is made from the URI and the payload, so
    equal responses have equal ids; repeated rows give repeated records. A null URI or date is left out of the headers.
    Rows of read_responses() that report a problem are left out. Pages of any length take time in proportion to it. An
    empty table gives an empty one; columns of the same names as those added are replaced.
    """
    own = ["record_id", "target_uri", "date", "http_headers", "payload", "payload_digest"]
    if "problem" in responses.columns:
        responses = responses.where("problem is null").drop("problem")
    kinds = {f.name: f.dataType.simpleString() for f in responses.schema}
    names = ["kind", "record_id", "refers_to", "target_uri", "source_headers", "source_digest", "block_digest", "block_length", "block", "record"]
    keep = others(responses, *own, *names) if keep is None else keep
    types = [pa.string()] * 7 + [pa.int64(), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                out, at = [], []
                for i, (rid, uri, date, head, payload, source) in enumerate(zip(*(part.column(len(keep) + j).to_pylist() for j in range(6)), strict=True)):
                    payload = payload or ""
                    source = source or digest(payload.encode())
                    rid = rid or record_id("response", uri or "", source)
                    page = Page(payload)
                    for kind, type_, block in (("metadata", "application/warc-fields", page.fields().encode()), ("conversion", "text/plain; charset=utf-8", page.text.encode())):
                        id_ = record_id(kind, rid)
                        headers = [("WARC-Refers-To", rid), *([("WARC-Target-URI", header_uri(uri))] if uri else []), *([("WARC-Date", date)] if date else []), ("WARC-Source-Payload-Digest", source), *(("WARC-Source-Header", h) for h in (head or "").split("\r\n") if h), ("Content-Type", type_)]
                        out.append((kind, id_, rid, uri, head, source, digest(block), len(block), block, record(kind, id_, headers, block) if records else None))
                        at.append(i)
                kept = part.take(pa.array(at, pa.int64())).columns[: len(keep)]
                yield pa.RecordBatch.from_arrays([*kept, *(pa.array(x, t) for x, t in zip(zip(*out) if out else [[]] * 10, types, strict=True))], [*keep, *names])

    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keep), *(f"{n} {'bigint' if n == 'block_length' else 'binary' if n in ('block', 'record') else 'string'}" for n in names)])
    return responses.select(*(F.col(k).alias(f"k{i}") for i, k in enumerate(keep)), *own).mapInArrow(run, schema)


def write_warc(derived: DataFrame, path: str) -> None:
    """The records as uncompressed WARC files, one for each partition. Spark's text sink commits them, so a lost executor leaves no half file; its line separator is the last line break of a record."""
    text = F.decode("record", "utf-8")
    derived.select(F.left(text, F.char_length(text) - 1).alias("value")).write.option("lineSep", "\n").text(path)
