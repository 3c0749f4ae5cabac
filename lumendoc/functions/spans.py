"""Elements of HTML as intervals, found in one scan with a stack and no tree."""

from __future__ import annotations

from html.parser import HTMLParser

from lumendoc.functions.dom import CLOSED_BY, IR_ID, RAW, VOID, WALLS


class _Scan(HTMLParser):
    """Opens and closes elements as ``dom.parse`` does.

    ``rows``: the elements in order.  ``text``: the visible text so far, of which
    each element has a range; ``strip``: each piece without the blanks at its ends.
    """

    def __init__(self, html: str, implied: bool = True, strip: bool = False):
        super().__init__(convert_charrefs=True)
        self.html, self.implied, self.strip = html, implied, strip
        self.lines = [0, *(k + 1 for k, c in enumerate(html) if c == "\n")]
        self.rows, self.open, self.count, self.text, self.length = [], [], 0, [], 0
        self.feed(html)
        self.close()
        self.cut(0, len(html), len(html))

    def place(self) -> int:
        line, column = self.getpos()
        return self.lines[line - 1] + column

    def cut(self, n: int, close: int, stop: int) -> None:
        """Close the open elements from the ``n``-th on."""
        while len(self.open) > n:
            self.open.pop().update(post=self.count, close=close, stop=stop, text_stop=self.length)
            self.count += 1

    def handle_starttag(self, tag, attrs):
        at = self.place()
        if self.implied:
            floor = next((k + 1 for k in range(len(self.open) - 1, -1, -1) if self.open[k]["tag"] in WALLS), 0)
            closed = next((k for k in range(floor, len(self.open)) if tag in CLOSED_BY.get(self.open[k]["tag"], ())), None)
            if closed is not None:
                self.cut(closed, at, at)
        end = at + len(self.get_starttag_text() or "")
        row = {"pre": self.count, "depth": len(self.open), "parent": self.open[-1]["pre"] if self.open else -1, "tag": tag, "attrs": {k: v or "" for k, v in attrs}, "start": at, "inner": end, "text_start": self.length, "raw": ""}
        row["ir_id"] = row["attrs"].get(IR_ID)
        self.count += 1
        self.rows.append(row)
        self.open.append(row)
        if tag in VOID:
            self.cut(len(self.open) - 1, end, end)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.cut(len(self.open) - 1, self.open[-1]["inner"], self.open[-1]["inner"])

    def handle_endtag(self, tag):
        n = next((k for k in range(len(self.open) - 1, -1, -1) if self.open[k]["tag"] == tag), None)
        if n is not None:
            at = self.place()
            self.cut(n + 1, at, at)
            self.cut(n, at, self.html.find(">", at) + 1 or len(self.html))

    def handle_data(self, data):
        if self.open and self.open[-1]["tag"] in RAW:
            self.open[-1]["raw"] += data
            return
        data = data.strip() if self.strip else data
        self.text.append(data)
        self.length += len(data)


def scan(html: str | None) -> dict:
    """text: what is visible, in order; elements: intervals of source and text, closed by implication as browsers do."""
    page = _Scan(html or "")
    return {"text": "".join(page.text), "elements": page.rows}


def identified(html: str | None, wanted: frozenset[str] | None = None) -> list[dict]:
    """Every identified element in order, or of these the wanted; a page that wants none is not read."""
    if not html or wanted is not None and not wanted:
        return []
    page, out, pos = _Scan(html, implied=False, strip=True), [], 0
    text = "".join(page.text)
    for x in page.rows:
        if x["ir_id"] is None:
            continue
        if wanted is None or x["ir_id"] in wanted:
            own, alt = x["raw"].strip() if x["tag"] in RAW else text[x["text_start"] : x["text_stop"]], x["attrs"].get("alt", "")
            out.append({"pos": pos, "ir_id": x["ir_id"], "tag": x["tag"], "text": own, "alt": alt, "empty": not own and not alt, "attrs": x["attrs"]})
        pos += 1
    return out
