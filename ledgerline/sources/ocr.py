"""Reading of images: engines by preference, a container by its streams, and the best of four rotations; `readers` says who is asked when.

Nothing here is needed where texts are in tables already; every engine is optional.
"""

from __future__ import annotations

import functools
import importlib.util
import shutil
import subprocess
from collections.abc import Callable, Sequence

#: A function from one page's image (PNG bytes) to its lines.
Engine = Callable[[bytes], list[str]]
ROTATIONS = (0, 90, 180, 270)
CONTAINER_SECONDS, ROTATE_THRESHOLD = 180, 5


# --- engines ---------------------------------------------------------------------


def lines_of(kind: str, answer) -> list[str]:
    """The lines in what an engine of that kind returns, whatever its form."""
    if kind == "rapidocr":  # (rows of (box, text, score), timings)
        rows = answer[0] if isinstance(answer, tuple) else answer
        return [str(row[1]) for row in rows or () if row and len(row) > 1]
    if kind == "paddleocr":  # pages of (box, (text, score)), or mappings with rec_texts
        out = []
        for page in answer or ():
            if isinstance(page, dict):
                out += map(str, page.get("rec_texts") or ())
            elif isinstance(page, (list, tuple)):
                out += [row if isinstance(row, str) else str(row[1][0] if isinstance(row[1], (list, tuple)) else row[1]) for row in page if row]
            elif page is not None:
                out.append(str(page))
        return out
    out = []  # layout models: markdown, text, or elements
    for part in answer or ():
        get = part.get if isinstance(part, dict) else functools.partial(getattr, part)
        whole = next((str(x) for x in (get("markdown", None), get("text", None)) if x), None)
        found = [whole] if whole is not None else [str(e["text"]) for e in (get("json", None) or {}).get("layout_elements", ()) if "text" in e]
        out += found or [str(part)]
    return out


def _rapid() -> Engine:
    from rapidocr_onnxruntime import RapidOCR

    engine = RapidOCR()
    return lambda image: lines_of("rapidocr", engine(image))


def _paddle() -> Engine:
    import tempfile

    from paddleocr import PaddleOCR

    engine = PaddleOCR()

    def read(image: bytes) -> list[str]:
        with tempfile.NamedTemporaryFile(suffix=".png") as file:
            file.write(image)
            file.flush()
            return lines_of("paddleocr", engine.ocr(file.name))

    return read


def _paddle_layout() -> Engine:
    import tempfile

    from paddleocr import PaddleOCRVL

    engine = PaddleOCRVL()

    def read(image: bytes) -> list[str]:
        with tempfile.NamedTemporaryFile(suffix=".png") as file:
            file.write(image)
            file.flush()
            return lines_of("paddleocr_vl", engine.predict(file.name))

    return read


#: Engines, best first: name, the module it needs, how it is made.
ENGINES = (("rapidocr", "rapidocr_onnxruntime", _rapid), ("paddleocr", "paddleocr", _paddle), ("paddleocr_vl", "paddleocr", _paddle_layout))


@functools.cache
def engine(engines: tuple = ENGINES) -> tuple[str, Engine] | None:
    """The first engine that can be made, once a worker; None if none can."""
    for name, module, make in engines:
        if importlib.util.find_spec(module) is None:
            continue
        try:
            return name, make()
        except Exception:  # an engine that does not start gives way to the next
            continue
    return None


def read_images(images: Sequence[bytes], read: Engine, fallback: Engine | None = None) -> str:
    """The pages' lines, each page under its heading; pages without lines are left out. A page that `read` fails on goes to `fallback`."""
    out = []
    for i, image in enumerate(images, 1):
        try:
            lines = read(image)
        except Exception:
            if fallback is None:
                raise
            lines = fallback(image)
        if lines:
            out.append(f"--- Page {i} (OCR) ---\n" + "\n".join(lines))
    return "\n\n".join(out)


# --- container ---------------------------------------------------------------------


def container_command(image: str, dpi: int = 200, force: bool = False, rotate: bool = True, runtime: str = "docker") -> list[str]:
    """The command line of a container that reads a document on its input and writes a searchable one on its output."""
    turned = ["--rotate-pages", "--rotate-pages-threshold", str(ROTATE_THRESHOLD)] if rotate else []
    return [runtime, "run", "--rm", "-i", image, "--image-dpi", str(dpi), *turned, "--deskew", "--force-ocr" if force else "--skip-text", "-", "-"]


def in_container(content: bytes, command: list[str], seconds: float = CONTAINER_SECONDS) -> bytes | None:
    """What the command makes of `content`; None if it is not there, fails, is too slow or says nothing."""
    if shutil.which(command[0]) is None:
        return None
    try:
        done = subprocess.run(command, input=content, capture_output=True, timeout=seconds)
    except (subprocess.TimeoutExpired, OSError):
        return None
    return done.stdout if done.returncode == 0 and done.stdout else None


# --- rotations -----------------------------------------------------------------------


def word_quality(text: str) -> tuple[int, float]:
    """Words with a letter or digit, and the share of them with two characters or more."""
    words = [w for w in text.split() if any(c.isascii() and c.isalnum() for c in w)]
    return len(words), sum(len(w) > 1 for w in words) / len(words) if words else 0.0


def best_rotation(pages: Sequence[bytes], read: Callable[[bytes, int], str]) -> tuple[str, int]:
    """All pages' text at the rotation that reads the first page best; of equal ones the smaller."""
    if not pages:
        return "", 0
    first = {r: read(pages[0], r) for r in ROTATIONS}
    turn = max(ROTATIONS, key=lambda r: (word_quality(first[r])[1], -r))
    texts = [first[turn], *(read(p, turn) for p in pages[1:])]
    return "\n\n".join(x for x in texts if x).strip(), turn
