"""Text of PDF files by the standard library: plain and Flate streams, object streams, ToUnicode maps.

What it does not read (encrypted files, other filters, fonts with encodings of their own and no map) comes out as pages without
text, so that the file counts as scanned.
"""

from __future__ import annotations

import re
import zlib

_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)
_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\n?endstream", re.S)
_REFERENCE = re.compile(rb"(\d+)\s+\d+\s+R\b")
_TOKEN = re.compile(rb"%[^\r\n]*|\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/<>\[\]()]+|[-+]?\d*\.?\d+|[A-Za-z'\"*]+", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _unescaped(raw: bytes) -> bytes:
    def one(m: re.Match) -> bytes:
        c = m[1]
        return bytes([int(c, 8) & 255]) if c[:1].isdigit() else b"" if c in (b"\n", b"\r", b"\r\n") else _ESCAPES.get(c, c)

    return re.sub(rb"\\([0-7]{1,3}|\r\n|.)", one, raw, flags=re.S)


class Document:
    def __init__(self, raw: bytes):
        if not raw.lstrip()[:5].startswith(b"%PDF"):
            raise ValueError("no PDF header")
        if re.search(rb"/Encrypt\s+\d+\s+\d+\s+R", raw):
            raise ValueError("encrypted")
        self.objects = {int(m[1]): m[2] for m in _OBJECT.finditer(raw)}
        for body in list(self.objects.values()):
            if b"/ObjStm" in body[:400]:
                self._unpack(body)

    def _unpack(self, body: bytes) -> None:
        """The objects of an object stream."""
        n, first = (re.search(rb"/" + k + rb"\s+(\d+)", body) for k in (b"N", b"First"))
        inside = self.stream(body)
        if n and first and inside:
            at = list(map(int, inside[: int(first[1])].split()[: 2 * int(n[1])]))
            ends = [*at[3::2], len(inside) - int(first[1])]
            for number, start, end in zip(at[::2], at[1::2], ends):
                self.objects.setdefault(number, inside[int(first[1]) + start : int(first[1]) + end])

    @staticmethod
    def stream(body: bytes) -> bytes:
        """A stream's bytes; empty for filters other than Flate."""
        m = _STREAM.search(body)
        if m is None:
            return b""
        head = body[: m.start()]
        if b"/Filter" not in head:
            return m[1]
        if b"/FlateDecode" not in head or re.search(rb"/(ASCII|LZW|RunLength|CCITT|DCT|JBIG2|JPX)", head):
            return b""
        return zlib.decompressobj().decompress(m[1])

    def entry(self, body: bytes, key: bytes) -> bytes:
        """What a dictionary has under a key: the object referred to, an array or a dictionary as they stand."""
        m = re.search(rb"/" + key + rb"\b\s*(\d+\s+\d+\s+R|\[[^\]]*\]|<<)", body)
        if m is None:
            return b""
        if m[1] == b"<<":
            depth, at = 1, m.end()
            while depth and (t := re.compile(rb"<<|>>").search(body, at)):
                depth, at = depth + (1 if t[0] == b"<<" else -1), t.end()
            return body[m.start(1) : at]
        if m[1][:1] == b"[":
            return m[1]
        return self.objects.get(int(m[1].split()[0]), b"")

    def pages(self) -> list[tuple[bytes, bytes]]:
        """(page, resources, inherited where the page has none) in the order of the page tree."""
        found: list[tuple[bytes, bytes]] = []
        seen: set[int] = set()
        root = next((b for b in self.objects.values() if re.search(rb"/Type\s*/Catalog\b", b)), b"")
        m = re.search(rb"/Pages\s+(\d+)\s+\d+\s+R", root)
        todo = [(int(m[1]), b"")] if m else []
        while todo:
            number, given = todo.pop()
            body = self.objects.get(number, b"")
            if number in seen:
                continue
            seen.add(number)
            own = self.entry(body, b"Resources") or given
            if re.search(rb"/Type\s*/Page\b", body):
                found.append((body, own))
            else:
                todo += [(int(k), own) for k in reversed(_REFERENCE.findall(self.entry(body, b"Kids")))]
        return found or [(b, self.entry(b, b"Resources")) for _, b in sorted(self.objects.items()) if re.search(rb"/Type\s*/Page\b", b)]

    def fonts(self, resources: bytes) -> dict[bytes, dict[bytes, str]]:
        fonts = self.entry(resources, b"Font")
        return {name: self._map(self.stream(self.entry(self.objects.get(int(n), b""), b"ToUnicode"))) for name, n in re.findall(rb"/([^\s/<>]+)\s+(\d+)\s+\d+\s+R", fonts)}

    @staticmethod
    def _map(cmap: bytes) -> dict[bytes, str]:
        """Codes to text by a ToUnicode map."""
        found: dict[bytes, str] = {}

        def text(h: bytes) -> str:
            return bytes.fromhex(re.sub(rb"\s", b"", h).decode()).decode("utf-16-be", "replace")

        for block in re.findall(rb"beginbfchar(.*?)endbfchar", cmap, re.S):
            for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f\s]+)>", block):
                found[bytes.fromhex(a.decode())] = text(b)
        for block in re.findall(rb"beginbfrange(.*?)endbfrange", cmap, re.S):
            for a, b, to in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*(<[0-9A-Fa-f\s]+>|\[[^\]]*\])", block):
                low, high, width = int(a, 16), int(b, 16), len(a) // 2
                many = re.findall(rb"<([0-9A-Fa-f\s]+)>", to)
                for i in range(min(high - low + 1, 1 << 16)):
                    if to[:1] == b"[":
                        said = text(many[i]) if i < len(many) else ""
                    else:
                        base = text(many[0])
                        said = base[:-1] + chr(ord(base[-1]) + i) if base else ""
                    found[(low + i).to_bytes(width, "big")] = said
        return found

    def text(self, page: bytes, resources: bytes) -> str:
        fonts = self.fonts(resources)
        ref = re.search(rb"/Contents\s*(\d+\s+\d+\s+R|\[[^\]]*\])", page)
        content = b"\n".join(self.stream(self.objects.get(int(n), b"")) for n in _REFERENCE.findall(ref[1])) if ref else b""
        out: list[str] = []
        held: list[bytes] = []
        codes: dict[bytes, str] = {}
        height = None

        def say(raw: bytes) -> None:
            string = bytes.fromhex((h := re.sub(rb"\s", b"", raw[1:-1]).decode()) + "0" * (len(h) % 2)) if raw[:1] == b"<" else _unescaped(raw[1:-1])
            if codes:
                width = max(map(len, codes))
                out.append("".join(codes.get(string[i : i + width], "") for i in range(0, len(string), width)))
            else:
                out.append(string[2:].decode("utf-16-be", "replace") if string[:2] == b"\xfe\xff" else string.decode("cp1252", "replace"))

        def line() -> None:
            if out and not out[-1].endswith("\n"):
                out.append("\n")

        for m in _TOKEN.finditer(content):
            t = m[0]
            if not (t[:1].isalpha() or t in (b"'", b'"', b"T*")):
                if t[:1] != b"%":
                    held.append(t)
                continue
            if t == b"Tf" and len(held) >= 2:
                codes = fonts.get(held[-2][1:], {})
            elif t in (b"Td", b"TD") and len(held) >= 2 and float(held[-1]) != 0 or t in (b"T*", b"ET"):
                line()
            elif t == b"Td" or t == b"TD":
                out.append(" ")
            elif t == b"Tm" and len(held) >= 6:
                if height is not None and held[-1] != height:
                    line()
                height = held[-1]
            elif t in (b"Tj", b"'", b'"') and held:
                if t != b"Tj":
                    line()
                say(held[-1])
            elif t == b"TJ":
                for piece in held:
                    if piece[:1] in b"(<":
                        say(piece)
                    elif re.fullmatch(rb"-?\d*\.?\d+", piece) and float(piece) < -200:
                        out.append(" ")  # a wide step back is a space between words
            held = []
        return "".join(out)


def page_texts(raw: bytes) -> list[str]:
    """The text of every page; raises ValueError for what is no readable PDF."""
    document = Document(raw)
    pages = document.pages()
    if not pages:
        raise ValueError("no pages")
    texts = []
    for page, resources in pages:
        try:
            texts.append(document.text(page, resources))
        except (ValueError, zlib.error, IndexError):  # one page must not lose the others
            texts.append("")
    return texts
