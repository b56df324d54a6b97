"""A lenient reader of XML-like markup: end tags need not match by name, comments and instructions go, unquoted attributes are empty."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

_REFERENCE = re.compile(r"&(?:(amp|lt|gt|quot|apos)|#(?:x([0-9A-Fa-f]+)|([0-9]+)));")
_NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)')?)?""")
_TAG = re.compile(r"""<(/?)([^\s/>]+)((?:[^>"']|"[^"]*"|'[^']*')*?)(/?)>""")


class MarkupError(ValueError):
    """Markup that no lenient reading makes sense of."""


@dataclass
class Node:
    """An element; a text node has an empty tag."""

    tag: str = ""
    text: str = ""
    attrs: dict[str, str] = field(default_factory=dict)
    children: list[Node] = field(default_factory=list)

    def child(self, tag: str) -> Node | None:
        return next((c for c in self.children if c.tag == tag), None)

    def all(self, tag: str) -> Iterator[Node]:
        """This node and those below it that have the tag, in document order."""
        stack = [self]
        while stack:
            n = stack.pop()
            if n.tag == tag:
                yield n
            stack.extend(reversed(n.children))

    def all_text(self) -> str:
        out, stack = [], [self]
        while stack:
            n = stack.pop()
            out.append(n.text)
            stack.extend(reversed(n.children))
        return "".join(out)


def unescape(text: str) -> str:
    """Named and numeric references, each once; others stay as they are."""

    def one(m: re.Match) -> str:
        if m[1]:
            return _NAMED[m[1]]
        digits = m[2] or m[3]
        if len(digits) > 8:
            return m[0]
        code = int(digits, 16 if m[2] else 10)
        return chr(code) if 0 < code < 0x110000 and not 0xD800 <= code < 0xE000 else "\ufffd"

    return _REFERENCE.sub(one, text)


def parse(source: str, void: frozenset[str] = frozenset()) -> list[Node]:
    """Root elements of a source. An end tag closes the innermost open element whatever its name; elements named in void have no content.

    Raises MarkupError for text outside of all elements, an element that is never closed, and an unterminated tag or comment.
    """
    roots: list[Node] = []
    open_: list[Node] = []
    at = 0
    while at < len(source):
        cut = source.find("<", at)
        text = source[at : cut if cut >= 0 else len(source)]
        if text:
            if open_:
                open_[-1].children.append(Node(text=unescape(text)))
            elif text.strip(" \t\r\n\f\v\ufeff"):
                raise MarkupError("text outside of all elements")
        if cut < 0:
            break
        if source.startswith(("<!--", "<?", "<!"), cut):
            end = "-->" if source.startswith("<!--", cut) else "?>" if source[cut + 1] == "?" else ">"
            at = source.find(end, cut)
            if at < 0:
                raise MarkupError("unterminated declaration or comment")
            at += len(end)
            continue
        m = _TAG.match(source, cut)
        if not m:
            raise MarkupError("unterminated tag")
        at = m.end()
        if m[1]:
            if open_:
                open_.pop()
            continue
        node = Node(m[2], attrs={a[1]: unescape(a[2] or a[3] or "") for a in _ATTRIBUTE.finditer(m[3])})
        (open_[-1].children if open_ else roots).append(node)
        if not m[4] and node.tag.lower() not in void:
            open_.append(node)
    if open_:
        raise MarkupError(f"<{open_[-1].tag}> is never closed")
    return roots


NODES = "node_id int, parent_id int, depth int, tag string, attrs map<string,string>, text string"


def node_rows(df: DataFrame, markup: str, keep: list[str], void: frozenset[str] = frozenset(), lenient: bool = False) -> DataFrame:
    """Every node of every document: the kept columns, node_id in document order, parent_id (null for roots), depth, tag ('' for text), attrs, text, error.

    Markup that can't be read gives one row with its error and no node; with lenient, what is open at the end is closed
    and text may stand anywhere (web pages).
    """
    schema = T.StructType([*df.select(*keep).schema.fields, *T._parse_datatype_string(NODES).fields, T.StructField("error", T.StringType())])
    arrow = pa.schema([("node_id", pa.int32()), ("parent_id", pa.int32()), ("depth", pa.int32()), ("tag", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())), ("text", pa.string()), ("error", pa.string())])

    def rows(source: str | None) -> list[tuple]:
        try:
            roots = parse(source or "", void) if not lenient else read_page(source or "", void)
        except MarkupError as e:
            return [(None, None, None, None, None, None, str(e))]
        out: list[tuple] = []
        stack = [(r, None, 0) for r in reversed(roots)]
        while stack:
            node, parent, depth = stack.pop()
            own = len(out)
            out.append((own, parent, depth, node.tag, list(node.attrs.items()), node.text, None))
            stack.extend((c, own, depth + 1) for c in reversed(node.children))
        return out

    def run(batches):
        for b in batches:
            found = [rows(x) for x in b.column(markup).to_pylist()]
            index = pa.array([k for k, f in enumerate(found) for _ in f], pa.int32())
            flat = [r for f in found for r in f]
            made = [pa.array([r[i] for r in flat], arrow.field(i).type) for i in range(len(arrow))]
            yield pa.RecordBatch.from_arrays([*[b.column(c).take(index) for c in keep], *made], names=[*keep, *arrow.names])

    names = list(dict.fromkeys([*keep, markup]))
    return df.select(*names).mapInArrow(run, schema)


def read_page(source: str, void: frozenset[str]) -> list[Node]:
    """A web page as written: end tags close the nearest open element of their name and what is open inside it; others are ignored."""
    root = Node("#page")
    open_ = [root]
    at = 0
    while at < len(source):
        cut = source.find("<", at)
        text = source[at : cut if cut >= 0 else len(source)]
        if text:
            open_[-1].children.append(Node(text=unescape(text)))
        if cut < 0:
            break
        if source.startswith("<!--", cut):
            end = source.find("-->", cut)
            at = end + 3 if end >= 0 else len(source)
            continue
        m = _TAG.match(source, cut)
        if not m or m[2][0] in "!?":
            end = source.find(">", cut)
            at = end + 1 if m or end >= 0 else len(source)
            continue
        at, tag = m.end(), m[2].lower()
        if m[1]:
            k = next((k for k in range(len(open_) - 1, 0, -1) if open_[k].tag == tag), 0)
            if k:
                del open_[k:]
            continue
        node = Node(tag, attrs={a[1].lower(): unescape(a[2] or a[3] or "") for a in _ATTRIBUTE.finditer(m[3])})
        open_[-1].children.append(node)
        if tag in ("script", "style"):
            end = source.lower().find(f"</{tag}", at)
            end = end if end >= 0 else len(source)
            if end > at:
                node.children.append(Node(text=source[at:end]))
            at = source.find(">", end) + 1 or len(source)
        elif not m[4] and tag not in void:
            open_.append(node)
    return root.children
