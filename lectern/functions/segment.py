"""Segmentation of one page's text; used inside Arrow functions, one page at a time."""

from __future__ import annotations

import re

# Words that open a statement, marks that end a proof, and separators in order of priority.
_STATEMENT = re.compile(r"(?:theorem|teorema|lemma|lema|proposition|proposición|definition|definición|corollary|corolario|example|ejemplo|exercise|ejercicio)", re.I)
_PROOF_END = re.compile(r"□|∎|Q\.E\.D\.|QED|Fin de la demostración|Fin de demostración", re.I)
SEPARATORS = ("\n\n", "\n", ". ", "? ", "! ", "; ", ", ", " ", "")


def atomic_blocks(text: str, size: int) -> list[str]:
    """Paragraphs grouped so that a statement stays with what follows it up to the end of its proof.

    Plain paragraphs are packed up to one and a half times size; an open statement has no limit, and an opening paragraph
    that holds an end mark itself does not close.
    """
    done: list[str] = []
    held: list[str] = []
    inside = False
    for p in (s for part in re.split(r"\n\s*\n", text) if (s := part.strip())):
        starts = bool(_STATEMENT.match(p))
        full = not inside and held and sum(map(len, held)) + 2 * len(held) + len(p) > 1.5 * size
        if held and (starts or full):
            done.append("\n\n".join(held))
            held = []
        held.append(p)
        if starts:
            inside = True
        elif inside and _PROOF_END.search(p):
            done.append("\n\n".join(held))
            held, inside = [], False
    return done + ["\n\n".join(held)] if held else done


def windows(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of at most size characters, cut at the first separator present, oversize ones at the next; tails of at most overlap are carried on."""
    rest = list(separators)
    sep = next((s for s in rest if s == "" or s in text), "")
    deeper = tuple(rest[rest.index(sep) + 1 :]) if sep in rest else ()
    parts = list(text) if sep == "" else [p for k, p in enumerate(re.split(f"(?={re.escape(sep)})", text)) if p]
    out: list[str] = []
    run: list[str] = []
    length = 0

    def emit() -> None:
        if piece := "".join(run).strip():
            out.append(piece)

    for p in parts:
        if len(p) > size and deeper:
            emit()
            run, length = [], 0
            out.extend(windows(p, size, overlap, deeper))
            continue
        if run and length + len(p) > size:
            emit()
            while run and (length > overlap or length + len(p) > size):
                length -= len(run.pop(0))
        run.append(p)
        length += len(p)
    emit()
    return out


def page_chunks(text: str, size: int, overlap: int) -> list[str]:
    """Chunks of a page: atomic blocks packed to size, larger blocks cut into windows."""
    if not text or not text.strip():
        return []
    out: list[str] = []
    cur = ""
    for block in atomic_blocks(text, size):
        if cur and len(cur) + len(block) + 2 <= size:
            cur += "\n\n" + block
            continue
        if cur:
            out.append(cur)
            cur = ""
        if len(block) > size:
            out.extend(windows(block, size, overlap))
        else:
            cur = block
    return out + [cur] if cur else out
