"""XML as a Spark data source that splits compressed files: `xmlparts`.

A partition is a range of a file's bytes. In an .xz file it has the blocks that begin in the range, as the file's own index tells;
in a .gz file the members that begin there, found by their magic and tried; in a plain file its bytes. A task decompresses
piece by piece, owns the elements whose first sign lies in its part, and reads on only to finish the last of them, so its memory
follows an element, not a block or a file. Elements are given as documents of their own: namespaces that the root declares are
declared in them.

    spark.dataSource.register(XmlParts)
    spark.read.format("xmlparts").option("tag", "entry").load("hdfs://host/dic/*.xml.xz")

Rows: path, part (where the range begins), n (place in the part), xml, error. A file that breaks off, or an element that doesn't
end, is a row with an error, behind what came before it. With option what=instructions, the bodies of the processing instructions
named by tag are given instead. Tags in comments, in CDATA sections and within an element of the same name are passed over. What
a range begins inside of rests on all ranges before it: read() finds that out by a pass over the files that have several ranges,
in which a task tells for each sign that may be open where its range begins what is open where it ends. Without read(), a range
is taken to begin outside of all three.
"""

from __future__ import annotations

import json
import lzma
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from florilege.operators.stored import opened, qualified

#: Bytes of a partition's range, and of what is read and decompressed at once.
SPLIT_BYTES, CHUNK = 64 << 20, 1 << 18
#: A tag's name, with its prefix, is found whole if it is no longer than this.
LONGEST_TOKEN = 256
#: The end tag of a root is looked for in so many of the last bytes.
TAIL = 4096
SCHEMA = "path string, part long, n long, xml string, error string"


class Broken(ValueError):
    """A file that breaks off."""


class ParseError(Broken):
    """XML that breaks off."""


# -- compressed files as streams of (bytes, whether they belong to the range)

Parts = Iterator[tuple[bytes, bool]]


def _plain(file, size: int, start: int, end: int) -> Parts:
    file.seek(start)
    at = start
    while at < size:
        got = file.read(min(CHUNK, (end if at < end else size) - at))
        if not got:
            raise Broken(f"the file ends at byte {at} of {size}")
        yield got, at < end
        at += len(got)


def _number(data: bytes, at: int) -> tuple[int, int]:
    """A number of seven bits a byte, and the place behind it."""
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if not byte & 0x80:
            return value, at


def xz_blocks(file, size: int) -> list[tuple[int, int, bytes]]:
    """(place, bytes, header of its stream) of every block, from the indexes at the end of the file's streams."""
    found: list[tuple[int, int, bytes]] = []
    end = size
    while end > 0:
        file.seek(end - 12)
        footer = file.read(12)
        if not any(footer[8:]) and not any(footer[-4:]):
            end -= 4  # padding between streams
            continue
        if footer[-2:] != b"YZ" or zlib.crc32(footer[4:10]) != int.from_bytes(footer[:4], "little"):
            raise Broken("no .xz footer at the end")
        length = 4 * (int.from_bytes(footer[4:8], "little") + 1)
        file.seek(end - 12 - length)
        index = file.read(length)
        if zlib.crc32(index[:-4]) != int.from_bytes(index[-4:], "little"):
            raise Broken("the .xz index is damaged")
        blocks, at = _number(index, 1)
        sizes = []
        for _ in range(blocks):
            unpadded, at = _number(index, at)
            _, at = _number(index, at)
            sizes.append(-(-unpadded // 4) * 4)
        begin = end - 12 - length - sum(sizes) - 12
        file.seek(begin)
        header = file.read(12)
        place = begin + 12
        own = []
        for x in sizes:
            own.append((place, x, header))
            place += x
        found = own + found
        end = begin
    return found


def _block(file, place: int, length: int, header: bytes, owned: bool) -> Parts:
    """What a block holds, in bounded pieces. A decoder that has seen a stream's header takes any block of it."""
    decoder = lzma.LZMADecompressor(lzma.FORMAT_XZ)
    decoder.decompress(header)
    end = place + length
    while True:
        got = b""
        if decoder.needs_input:
            file.seek(place)
            got = file.read(min(CHUNK, end - place))
            if not got:
                return
            place += len(got)
        out = decoder.decompress(got, CHUNK)
        if out:
            yield out, owned


def _xz(file, size: int, start: int, end: int) -> Parts:
    try:
        blocks = xz_blocks(file, size)
    except (Broken, IndexError):
        if not start:  # the first range has what can be read of a file without a sound index
            file.seek(0)
            with lzma.open(file) as whole:
                while got := whole.read1(CHUNK):
                    yield got, True
            raise
        return
    for place, length, header in blocks:
        if place >= start:
            yield from _block(file, place, length, header, place < end)


MAGIC = b"\x1f\x8b\x08"


def _member(file, place: int) -> Iterator[bytes | int]:
    """Pieces of the gzip member at a place, and at last the place behind it; zlib.error if there is none."""
    decoder = zlib.decompressobj(31)
    file.seek(place)
    at, waiting = place, b""
    while not decoder.eof:
        if not waiting:
            file.seek(at)  # others read the file meanwhile
            waiting = file.read(CHUNK)
            if not waiting:
                raise Broken(f"the member at byte {place} breaks off")
            at += len(waiting)
        out = decoder.decompress(waiting, CHUNK)
        waiting = decoder.unconsumed_tail
        if out:
            yield out
    yield at - len(decoder.unused_data)


def _member_at(file, size: int, start: int, end: int) -> int | None:
    """Where the first member in [start, end) begins: the first magic from which a piece can be decoded."""
    at = start
    while at < end:
        file.seek(at)
        data = file.read(min(CHUNK, size - at))
        k = data.find(MAGIC)
        while k >= 0 and at + k < end:
            if k + 3 < len(data) and not data[k + 3] & 0xE0:
                try:
                    next(_member(file, at + k))
                    return at + k
                except (zlib.error, Broken):
                    pass
            k = data.find(MAGIC, k + 1)
        if len(data) <= 3:
            return None
        at += len(data) - 3
    return None


def _gz(file, size: int, start: int, end: int) -> Parts:
    place = _member_at(file, size, start, end)
    while place is not None and place < size:
        owned, after = place < end, place
        for piece in _member(file, place):
            if isinstance(piece, int):
                after = piece
            else:
                yield piece, owned
        place = after
        while place < size:  # zeros may pad a member
            file.seek(place)
            got = file.read(512)
            if got.lstrip(b"\0"):
                place += len(got) - len(got.lstrip(b"\0"))
                break
            place += len(got)


def pieces(file, path: str, size: int, start: int, end: int) -> Parts:
    kind = _xz if path.endswith(".xz") else _gz if path.endswith(".gz") else _plain
    return kind(file, size, start, end)


# -- elements


class Window:
    """The part of a stream that is looked at; places are counted from the stream's begin."""

    def __init__(self, parts: Parts):
        self.parts, self.data, self.base = parts, bytearray(), 0
        self.owned, self.more, self.tail = 0, True, b""

    def end(self) -> int:
        return self.base + len(self.data)

    def pull(self) -> bool:
        got = next(self.parts, None)
        if got is None:
            self.more = False
            return False
        if got[1]:
            self.owned = self.end() + len(got[0])
        else:
            self.more = False
        self.data += got[0]
        self.tail = (self.tail + got[0])[-TAIL:]
        return True

    def drop(self, upto: int) -> None:
        del self.data[: max(0, upto - self.base)]
        self.base = max(self.base, upto)

    def search(self, token: re.Pattern, at: int, hold: int | None = None) -> re.Match | None:
        """The first match from a place on; no token begins within another. What stands from `hold` on is kept. Without hold,
        all before the match may go, and the search ends where the range does."""
        while True:
            if found := token.search(self.data, at - self.base):
                return found
            at = max(at, self.end() - LONGEST_TOKEN)
            if hold is None:
                self.drop(at)
                if not self.more and at >= self.owned:
                    return None
            if not self.pull():
                return None

    def find(self, sign: bytes, at: int, hold: int | None = None) -> int:
        """The place behind the next sign."""
        while True:
            k = self.data.find(sign, max(0, at - self.base))
            if k >= 0:
                return self.base + k + len(sign)
            at = max(at, self.end() - len(sign) + 1)
            if hold is None:
                self.drop(at)
            if not self.pull():
                raise ParseError(f"{sign.decode()} is missing")


_ATTRIBUTES = re.compile(rb"""[^>"']*(?:(?:"[^"]*"|'[^']*')[^>"']*)*>""")
_SKIPPED = {b"<!--": b"-->", b"<![CDATA[": b"]]>"}


def _tokens(tag: str, closing: bool) -> re.Pattern:
    name = re.escape(tag.encode())
    return re.compile(rb"<!--|<!\[CDATA\[|<(%s)(?:[\w.-]+:)?%s(?=[\s/>])" % (b"/?" if closing else b"", name))


def _tag_end(window: Window, at: int, hold: int) -> tuple[int, bool]:
    """The place behind a tag whose name ends at a place, and whether the tag closes itself."""
    while True:
        found = _ATTRIBUTES.match(window.data, at - window.base)
        if found:
            return window.base + found.end(), window.data[found.end() - 2 : found.end()] == b"/>"
        if not window.pull():
            raise ParseError("a tag doesn't end")


def elements(window: Window, tag: str, within: bytes = b"", depth: int = 0) -> Iterator[bytes]:
    """Elements of that name (and any prefix) that begin in the range; inner ones of the same name are part of the outer. The range
    may begin inside of what a sign of _SKIPPED opened, or of so many elements of the name."""
    opens, inside = _tokens(tag, False), _tokens(tag, True)
    at = 0
    try:
        if within:
            at = window.find(_SKIPPED[within], at)
        while depth:
            found = window.search(inside, at)
            if not found or window.base + found.start() >= window.owned:
                return
            end = window.base + found.end()
            if found[0] in _SKIPPED:
                at = window.find(_SKIPPED[found[0]], end)
                continue
            at, closed = _tag_end(window, end, window.base + found.start())
            depth += -1 if found[1] else 0 if closed else 1
    except Broken:
        return
    while found := window.search(opens, at):
        begin, sign = window.base + found.start(), found[0]
        if begin >= window.owned:
            return
        if sign in _SKIPPED:
            try:
                at = window.find(_SKIPPED[sign], window.base + found.end())
            except Broken:
                return
            continue
        at, closed = _tag_end(window, window.base + found.end(), begin)
        depth = 0 if closed else 1
        while depth:
            found = window.search(inside, at, begin)
            if not found:
                raise ParseError(f"<{tag}> isn't closed")
            end = window.base + found.end()
            if found[0] in _SKIPPED:
                at = window.find(_SKIPPED[found[0]], end, begin)
                continue
            at, closed = _tag_end(window, end, begin)
            depth += -1 if found[1] else 0 if closed else 1
        yield bytes(window.data[begin - window.base : at - window.base])
        window.drop(at)


def _followed(window: Window, tokens: re.Pattern, at: int, within: bytes, members: list[list]) -> tuple[int, bytes]:
    """From a place on, inside of `within`: how far the window's data lead, and what is open there. members: [sign, growth of depth,
    least of it on the way], kept up to date. What begins in the range is followed to its end, what begins behind it isn't."""
    while True:
        if within:
            sign = _SKIPPED[within]
            k = window.data.find(sign, max(0, at - window.base))
            if k < 0:
                return max(at, window.end() - len(sign) + 1), within
            if window.base + k >= window.owned:
                return max(at, window.owned), within
            at, within = window.base + k + len(sign), b""
            continue
        found = tokens.search(window.data, max(0, at - window.base))
        if not found:
            return max(at, window.end() - LONGEST_TOKEN), within
        begin = window.base + found.start()
        if begin >= window.owned:
            return max(at, window.owned), within
        if found[0] in _SKIPPED:
            at, within = window.base + found.end(), found[0]
            continue
        tag = _ATTRIBUTES.match(window.data, found.end())
        if not tag:
            return begin, within
        step = -1 if found[1] else 0 if window.data[tag.end() - 2 : tag.end()] == b"/>" else 1
        for member in members:
            member[1] += step
            member[2] = min(member[2], member[1])
        at = window.base + tag.end()


def passages(window: Window, tag: str) -> dict[bytes, tuple[bytes, int, int]]:
    """What a range does to what it begins inside of: per sign that is open at its begin (none: empty), the sign that is open at
    its end, the growth of the depth of elements of that name, and the least of that growth on the way. Ways that come to the same
    place go on as one."""
    tokens = _tokens(tag, True)
    ways = {(0, sign): [[sign, 0, 0]] for sign in (b"", *_SKIPPED)}
    while window.more or any(at < window.owned for at, _ in ways):
        pulled = window.pull()
        led: dict[tuple[int, bytes], list[list]] = {}
        for (at, within), members in ways.items():
            led.setdefault(_followed(window, tokens, at, within, members), []).extend(members)
        ways = led
        window.drop(min(at for at, _ in ways))
        if not pulled:
            break
    return {sign: (within, growth, least) for (_, within), members in ways.items() for sign, growth, least in members}


def instructions(window: Window, name: str) -> Iterator[bytes]:
    """Bodies of the processing instructions of that name that begin in the range, wherever they stand."""
    begins = re.compile(rb"<\?%s(?=\s)" % re.escape(name.encode()))
    at = 0
    while found := window.search(begins, at):
        begin, body = window.base + found.start(), window.base + found.end()
        if begin >= window.owned:
            return
        at = window.find(b"?>", body, begin)
        yield bytes(window.data[body - window.base : at - 2 - window.base]).strip()
        window.drop(at)


_ROOT = re.compile(rb"""<([^\s!?/>][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""")
_DECLARED = re.compile(rb"""\s(xmlns(?::[\w.-]+)?)\s*=\s*("[^"]*"|'[^']*')""")
_ENCODING = re.compile(rb"""<\?xml\s[^>]*?encoding\s*=\s*["']([\w.-]+)["']""")
_PROLOG = re.compile(rb"<!--.*?-->|<\?.*?\?>|<!DOCTYPE(?:[^\[>]|\[.*?\])*>", re.DOTALL)


def head_of(parts: Parts, most: int = 1 << 20) -> tuple[bytes, bytes, str]:
    """(name of the root, its namespace declarations, encoding) of a document."""
    data = b""
    for piece, _ in parts:
        data += piece
        seen = _PROLOG.sub(b" ", data)
        if (found := _ROOT.search(seen)) and b"<!--" not in seen[: found.start()]:
            coded = _ENCODING.match(data.lstrip(b"\xef\xbb\xbf"))
            declared = b"".join(b" %s=%s" % pair for pair in _DECLARED.findall(found[2]))
            return found[1] + (b"/" if found[2].endswith(b"/") else b""), declared, coded[1].decode() if coded else "utf-8"
        if len(data) > most:
            break
    raise ParseError("there is no root element")


def standalone(element: bytes, declared: bytes) -> bytes:
    """An element with the declarations that it hasn't of its own."""
    name = re.match(rb"<[^\s/>]+", element)
    tag = element[: _ATTRIBUTES.match(element, name.end()).end()]
    own = {k for k, _ in _DECLARED.findall(tag)}
    added = b"".join(b" %s=%s" % (k, v) for k, v in _DECLARED.findall(declared) if k not in own)
    return name[0] + added + element[name.end() :]


# -- the data source


def fixed(path: str) -> str:
    """The folder that a pattern stands below, or the path itself."""
    sign = re.search(r"[*?]", path)
    return path[: sign.start()].rpartition("/")[0] if sign else path


def listed(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, of the files below a folder, or of those that a pattern of * and ? fits, in order. Names with _
    or . in front are left out."""
    from pyarrow import fs

    system, root = opened(fixed(path))
    known = system.get_file_info(root)
    if known.type == fs.FileType.File:
        return [(root, known.size)]
    if known.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    signs = {"*": "[^/]*", "?": "[^/]"}
    wanted = re.compile("".join(signs.get(c, re.escape(c)) for c in path[len(fixed(path)) :].strip("/")) + "(?:^|/|$).*")
    rows = []
    for info in system.get_file_info(fs.FileSelector(root, recursive=True)):
        below = info.path[len(root) :].strip("/")
        hidden = any(x[:1] in "_." for x in below.split("/"))
        if info.type == fs.FileType.File and not hidden and wanted.match(below):
            rows.append((info.path, info.size))
    return sorted(rows)


class XmlParts(DataSource):
    """spark.read.format("xmlparts"): see the module."""

    @classmethod
    def name(cls) -> str:
        return "xmlparts"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> XmlPartsReader:
        return XmlPartsReader(dict(self.options))


class XmlPartsReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.tag = options["path"], options["tag"]
        self.what = options.get("what", "elements")
        self.split = int(options.get("split", SPLIT_BYTES))
        self.begins = json.loads(options.get("begins", "{}"))

    def partitions(self) -> list[InputPartition]:
        """Ranges of files; only their sizes are looked at here."""
        ranges = [(path, size, k) for path, size in listed(self.path) for k in range(0, max(size, 1), self.split)]
        if self.what == "passages":  # the last range of a file leads to none
            ranges = [x for x in ranges if x[2] + self.split < x[1]]
        return [InputPartition(x) for x in ranges] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition.value is None:
            return
        path, size, start = partition.value
        rows: list[dict] = []
        held = 0
        for row in self._rows(path, size, start):
            rows.append(row)
            held += len(row["xml"] or "")
            if held > 4 << 20 or len(rows) >= 10_000:
                yield self._batch(rows)
                rows, held = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(rows, schema=pa.schema([("path", pa.string()), ("part", pa.int64()), ("n", pa.int64()), ("xml", pa.string()), ("error", pa.string())]))

    def _rows(self, path: str, size: int, start: int) -> Iterator[dict]:
        system, _ = opened(fixed(self.path))
        n = 0
        with system.open_input_file(path) as file:
            try:
                window = Window(pieces(file, path, size, start, min(size, start + self.split)))
                if self.what == "instructions":
                    for body in instructions(window, self.tag):
                        yield {"path": path, "part": start, "n": n, "xml": body.decode("utf-8", "replace"), "error": None}
                        n += 1
                    return
                if self.what == "passages":
                    for sign, (within, growth, least) in passages(window, self.tag).items():
                        yield {"path": path, "part": start, "n": n, "xml": json.dumps([sign.decode(), within.decode(), growth, least]), "error": None}
                        n += 1
                    return
                root, declared, encoding = b"", b"", "utf-8"
                within, depth = self.begins.get(f"{path}:{start}", ("", 0))
                for element in elements(window, self.tag, within.encode(), depth):
                    if not root:
                        with system.open_input_file(path) as again:
                            root, declared, encoding = head_of(pieces(again, path, size, 0, size))
                    yield {"path": path, "part": start, "n": n, "xml": standalone(element, declared).decode(encoding), "error": None}
                    n += 1
                self._finished(system, path, size, window)
            except (Broken, zlib.error, lzma.LZMAError, EOFError, UnicodeDecodeError, LookupError) as e:
                yield {"path": path, "part": start, "n": n, "xml": None, "error": f"{type(e).__name__}: {e}"}

    @staticmethod
    def _finished(system, path: str, size: int, window: Window) -> None:
        """Fail if the file ends in this range without its root being closed."""
        while window.more:
            window.drop(window.end())
            window.pull()
        if window.end() > window.owned or not window.owned:
            return  # the file goes on behind the range, or nothing of it begins here
        last = window.tail
        with system.open_input_file(path) as again:
            root, _, _ = head_of(pieces(again, path, size, 0, size))
            if window.end() < TAIL:  # too little to judge by
                last = b""
                for piece, _ in pieces(again, path, size, 0, size):
                    last = (last + piece)[-TAIL:]
        tail = re.compile(rb"(?:<%s[^<>]*/|</%s\s*)>(?:\s|<!--.*?-->|<\?.*?\?>)*\Z" % (re.escape(root.rstrip(b"/")), re.escape(root.rstrip(b"/"))), re.DOTALL)
        if not tail.search(last):
            raise ParseError(f"<{root.decode()}> isn't closed")


def _begins(rows: list[tuple[str, int, str | None]], split: int) -> dict[str, tuple[str, int]]:
    """From (path, part, passage): the sign and the depth that a range begins inside of, for those that begin inside of any."""
    led: dict[tuple[str, int], dict[str, tuple]] = {}
    for path, part, passage in rows:
        sign, *rest = json.loads(passage) if passage else ("", "", 0, 0)
        led.setdefault((path, part), {})[sign] = tuple(rest)
    found: dict[str, tuple[str, int]] = {}
    file, within, depth = None, "", 0
    for path, part in sorted(led):
        if path != file:
            file, within, depth = path, "", 0
        within, growth, least = led[path, part].get(within, (within, 0, 0))
        # an end tag without a begin counts for nothing
        depth = max(depth + growth, growth - least)
        if within or depth:
            found[f"{path}:{part + split}"] = (within, depth)
    return found


def read(spark: SparkSession, path: str, tag: str, what: str = "elements", split: int = SPLIT_BYTES) -> DataFrame:
    """SCHEMA's rows of a file, a folder or a pattern. Where a file has several ranges, a first pass brings a row for each range
    and sign to the driver, and no text."""
    spark.dataSource.register(XmlParts)
    path = qualified(spark, path)
    reader = spark.read.format("xmlparts").option("tag", tag).option("split", split)
    try:
        several = what == "elements" and any(size > split for _, size in listed(path))
    except FileNotFoundError:
        several = False  # the source says so itself
    if several:
        rows = reader.option("what", "passages").load(path).select("path", "part", "xml").collect()
        reader = reader.option("begins", json.dumps(_begins(rows, split)))
    return reader.option("what", what).load(path)
