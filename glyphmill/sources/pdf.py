"""A PDF source in plain Python for files of the simple kind: classic or compressed streams, simple fonts, text and path operators.

``spark.read.format("binaryFile")`` gives the bytes; ``read_pdf`` turns each file into drawing operators and text items on
the executors.  Encrypted files and files without a readable page give no rows and an error text instead.  Streams are
inflated up to LIMIT bytes each.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

LIMIT = 200_000_000
_OBJECT = re.compile(rb"(\d+)\s+(\d+)\s+obj\b(.*?)\bendobj", re.S)
_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\nendstream", re.S)
_TOKEN = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/\[\]()<>]+|[-+]?\d*\.?\d+|[A-Za-z'\"*]+")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def objects_of(data: bytes) -> dict[int, bytes]:
    """Objects by number; those of compressed object streams included."""
    out = {int(m[1]): m[3] for m in _OBJECT.finditer(data)}
    for body in list(out.values()):
        if b"/ObjStm" in body:
            raw = stream_of(body)
            n, first = (int(re.search(rb"/" + k + rb"\s+(\d+)", body)[1]) for k in (b"N", b"First"))
            head = [int(x) for x in raw[:first].split()[: 2 * n]]
            places = list(zip(head[::2], head[1::2], strict=True))
            for (number, at), end in zip(places, [p[1] for p in places[1:]] + [len(raw) - first], strict=True):
                out.setdefault(number, raw[first + at : first + end])
    return out


def stream_of(body: bytes) -> bytes:
    found = _STREAM.search(body)
    if not found:
        return b""
    raw = found[1]
    if b"/FlateDecode" in body[: found.start()]:
        try:
            raw = zlib.decompressobj().decompress(raw, LIMIT)
        except zlib.error:
            return b""
    return raw


def _ref(body: bytes, key: bytes) -> list[int]:
    m = re.search(rb"/" + key + rb"\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", body)
    return [int(x) for x in re.findall(rb"(\d+)\s+\d+\s+R", m[1])] if m else []


def pages_of(objects: dict[int, bytes]) -> list[bytes]:
    """Bodies of the pages in the order of the page tree."""
    root = next((b for b in objects.values() if re.search(rb"/Type\s*/Catalog", b)), b"")
    out: list[bytes] = []

    def walk(number: int, seen: frozenset[int]) -> None:
        body = objects.get(number, b"")
        if number in seen:
            return
        if re.search(rb"/Type\s*/Pages", body):
            for kid in _ref(body, b"Kids"):
                walk(kid, seen | {number})
        elif body:
            out.append(body)

    for top in _ref(root, b"Pages"):
        walk(top, frozenset())
    return out or [b for _, b in sorted(objects.items()) if re.search(rb"/Type\s*/Page\b", b)]


def _box(page: bytes) -> tuple[float, float]:
    m = re.search(rb"/MediaBox\s*\[([^\]]*)\]", page)
    v = [float(x) for x in m[1].split()] if m else [0, 0, 612, 792]
    return (v[2] - v[0], v[3] - v[1]) if len(v) == 4 else (612.0, 792.0)


def _string(token: bytes) -> str:
    if token[:1] == b"<":
        raw = bytes.fromhex(re.sub(rb"\s", b"", token[1:-1]).decode().ljust((len(re.sub(rb"\s", b"", token[1:-1])) + 1) // 2 * 2, "0"))
    else:
        raw = re.sub(rb"\\([0-7]{1,3}|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else _ESCAPES.get(m[1], m[1]), token[1:-1], flags=re.S)
    return raw.decode("utf-16-be", "replace") if raw[:2] == b"\xfe\xff" else raw.decode("cp1252", "replace")


def _times(a: list[float], b: list[float]) -> list[float]:
    return [a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5]]


#: Names of the drawing operators that other parts of the engine read.
OPERATORS = {"q": "save", "Q": "restore", "cm": "transform", "m": "move", "l": "line", "c": "curve", "re": "rectangle", "h": "close", "RG": "stroke_color", "rg": "fill_color", "w": "line_width", "S": "stroke", "f": "fill", "f*": "eo_fill", "B": "fill_stroke", "n": "end_path"}


def content_of(content: bytes, fonts: dict[str, str]) -> tuple[list[dict], list[tuple[str, list[float]]]]:
    """Text items (text, x, y, width, font_size, font_family) and drawing operators of a page's content."""
    items, ops = [], []
    stack: list = []
    ctm, saved = [1.0, 0, 0, 1, 0, 0], []
    text, line, font, size, leading, rise = [1.0, 0, 0, 1, 0, 0], [1.0, 0, 0, 1, 0, 0], "", 12.0, 0.0, 0.0

    def show(said: str) -> None:
        nonlocal text
        m = _times(text, ctm)
        scale = (m[0] ** 2 + m[1] ** 2) ** 0.5
        width = len(said) * size * 0.5
        if said.strip():
            items.append({"text": said, "x": m[4], "y": m[5] + rise, "width": width * scale, "height": size * scale, "font_size": size * scale, "font_family": fonts.get(font, font)})
        text = _times([1, 0, 0, 1, width, 0], text)

    def next_line(x: float, y: float) -> None:
        nonlocal text, line
        line = _times([1, 0, 0, 1, x, y], line)
        text = line

    for t in _TOKEN.findall(content):
        if t[:1] in (b"(", b"<"):
            stack.append(_string(t))
        elif t == b"[":
            stack.append("[")
        elif t == b"]":
            at = max(i for i, v in enumerate(stack) if v == "[") if "[" in stack else 0
            stack = stack[:at] + [stack[at + 1 :]]
        elif t[:1] == b"/":
            stack.append(t[1:].decode("latin-1"))
        elif re.fullmatch(rb"[-+]?\d*\.?\d+", t):
            stack.append(float(t))
        else:
            op, args = t.decode("latin-1"), stack
            numbers = [v for v in args if isinstance(v, float)]
            stack = []
            if op in OPERATORS:
                colour = op in ("RG", "rg")
                ops.append((OPERATORS[op], [v * 255 for v in numbers] if colour else numbers))
            if op == "q":
                saved.append(ctm)
            elif op == "Q" and saved:
                ctm = saved.pop()
            elif op == "cm" and len(numbers) == 6:
                ctm = _times(numbers, ctm)
            elif op == "BT":
                text = line = [1.0, 0, 0, 1, 0, 0]
            elif op == "Tf" and args and numbers:
                font, size = str(args[0]), numbers[-1]
            elif op == "TL" and numbers:
                leading = numbers[0]
            elif op == "Ts" and numbers:
                rise = numbers[0]
            elif op in ("Td", "TD") and len(numbers) == 2:
                leading = -numbers[1] if op == "TD" else leading
                next_line(*numbers)
            elif op == "Tm" and len(numbers) == 6:
                text = line = numbers
            elif op == "T*":
                next_line(0, -leading)
            elif op in ("Tj", "'", '"') and args:
                if op != "Tj":
                    next_line(0, -leading)
                show(str(args[-1]))
            elif op == "TJ" and args and isinstance(args[-1], list):
                for v in args[-1]:
                    if isinstance(v, str):
                        show(v)
                    elif isinstance(v, float):
                        text = _times([1, 0, 0, 1, -v / 1000 * size, 0], text)
    return items, ops


def parse(data: bytes) -> dict:
    """pages (width, height, items, ops), meta, error."""
    if not data.startswith(b"%PDF"):
        return {"pages": [], "meta": {}, "error": "not a PDF"}
    if b"/Encrypt" in data:
        return {"pages": [], "meta": {}, "error": "encrypted"}
    objects = objects_of(data)
    pages = []
    for page in pages_of(objects):
        width, height = _box(page)
        content = b"\n".join(stream_of(objects.get(n, b"")) for n in _ref(page, b"Contents"))
        resources = page + b"".join(objects.get(n, b"") for n in _ref(page, b"Resources"))
        fonts = {}
        for name, number in re.findall(rb"/(\w+)\s+(\d+)\s+0\s+R", resources):
            base = re.search(rb"/BaseFont\s*/([^\s/>\]]+)", objects.get(int(number), b""))
            if base:
                fonts[name.decode("latin-1")] = base[1].decode("latin-1")
        items, ops = content_of(content, fonts)
        pages.append({"width": width, "height": height, "items": items, "ops": ops})
    info = next((b for b in objects.values() if re.search(rb"/(Producer|Creator|Title|Author)\s*\(", b)), b"")
    meta = {k.decode(): _string(v) for k, v in re.findall(rb"/(Title|Author|Subject|Keywords|Creator|Producer|CreationDate|ModDate)\s*(\((?:[^()\\]|\\.)*\))", info)}
    return {"pages": pages, "meta": meta, "error": None if pages else "no page"}


_ITEMS = "path string, page_no int, item_no int, text string, x double, y double, width double, height double, font_size double, font_family string"
_OPS = "path string, page_no int, op_no int, fn string, args array<double>"
_DOCUMENTS = "path string, page_count int, meta map<string,string>, error string"


def files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path).select("path", "content")


def read_pdf(binary: DataFrame, kind: str = "items") -> DataFrame:
    """(path, content) -> the child table ``kind``: items, ops or documents.  Each is a source of its own, so what is not asked for is not made."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                found = parse(bytes(content))
                if kind == "documents":
                    rows.append((path, len(found["pages"]), found["meta"], found["error"]))
                for n, page in enumerate(found["pages"]):
                    if kind == "items":
                        rows += [(path, n, i, *(t[k] for k in ("text", "x", "y", "width", "height", "font_size", "font_family"))) for i, t in enumerate(page["items"])]
                    elif kind == "ops":
                        rows += [(path, n, i, fn, args) for i, (fn, args) in enumerate(page["ops"])]
            schema = {"items": _ITEMS, "ops": _OPS, "documents": _DOCUMENTS}[kind]
            names = [c.split()[0] for c in re.sub(r"<[^>]*>", "", schema).split(", ")]
            yield pd.DataFrame({c: pd.Series([r[i] for r in rows], dtype=object) for i, c in enumerate(names)})

    return binary.mapInPandas(each, {"items": _ITEMS, "ops": _OPS, "documents": _DOCUMENTS}[kind])
