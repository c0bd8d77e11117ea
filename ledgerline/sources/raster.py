"""Page images: dark lines on bright paper as segments, and the checks of a scan that follow from them.

A page is a grey image (rows of 0 to 255). Rendering a page is a function that is
given, and numpy tells its ink; ruled lines are found in the pixels by
`operators.lines`, and `layout.scan_quality` judges them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import layout, lines

#: Side of the neighbourhood and how much darker than its mean ink is.
NEIGHBOURHOOD, DARKER = 25, 15

#: A function from a document's bytes and a page number (from 0) to the grey image, or None where there is no such page.
Render = Callable[[bytes, int], np.ndarray | None]


def ink(grey: np.ndarray) -> np.ndarray:
    """Pixels that are darker than the mean of their neighbourhood by more than DARKER; the edge repeats beyond the image."""
    reach = NEIGHBOURHOOD // 2
    wide = np.pad(grey.astype(np.int64), reach, mode="edge")
    sums = np.pad(wide.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    n = NEIGHBOURHOOD
    means = (sums[n:, n:] - sums[:-n, n:] - sums[n:, :-n] + sums[:-n, :-n]) / n**2
    return grey < means - DARKER


def page_pixels(docs: DataFrame, render: Render, page: int = 0) -> DataFrame:
    """(doc_id, page_no, x, y, width, height, error) of one page of each document (doc_id, content): a row for the page, without x and y, and one for each ink pixel."""
    key = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "page_no", "x", "y", "width", "height", "error"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doc, content in zip(batch["doc_id"], batch["content"], strict=True):
                size, why, x, y = (None, None), None, [], []
                try:
                    grey = render(bytes(content), page)
                    if grey is None:
                        why = "no such page"
                    else:
                        size = grey.shape[1], grey.shape[0]
                        y, x = np.nonzero(ink(grey))
                except Exception as e:  # a page that cannot be drawn is that page's status
                    why = f"{type(e).__name__}: {e}"
                frame = pd.DataFrame({"doc_id": [doc] * (len(x) + 1), "page_no": page + 1, "x": [None, *x], "y": [None, *y], "width": size[0], "height": size[1], "error": [why] + [None] * len(x)}, columns=names)
                yield frame.astype({c: "Int32" for c in ("page_no", "x", "y", "width", "height")})

    return docs.select("doc_id", "content").mapInPandas(run, f"doc_id {key}, page_no int, x int, y int, width int, height int, error string")


def scan_checks(docs: DataFrame, render: Render, page: int = 0) -> DataFrame:
    """`layout.scan_quality` of one page of each document; documents whose page cannot be drawn have nulls and an error."""
    from .folders import checkpointed

    drawn = checkpointed(page_pixels(docs, render, page))
    pages = drawn.filter(F.col("x").isNull()).select("doc_id", "page_no", "width", "height", "error")
    ruled = checkpointed(lines.segments(drawn.filter(F.col("x").isNotNull()), pages))
    quality = layout.scan_quality(pages.filter(F.col("error").isNull()).select("doc_id", "page_no"), ruled)
    return pages.select("doc_id", "page_no", "error").join(quality, ["doc_id", "page_no"], "left")


def page_skew(docs: DataFrame, render: Render, page: int = 0) -> DataFrame:
    """(doc_id, page_no, skew_deg): null where there is no grid or no page."""
    return scan_checks(docs, render, page).select("doc_id", "page_no", "skew_deg")


def pdf_renderer(dpi: int = 200) -> Render | None:
    """Draws PDF pages, where the library for it is installed."""
    import importlib.util

    if importlib.util.find_spec("pypdfium2") is None:
        return None

    def render(content: bytes, page: int) -> np.ndarray | None:
        import pypdfium2

        pdf = pypdfium2.PdfDocument(content)
        try:
            if page >= len(pdf):
                return None
            pixels = pdf[page].render(scale=dpi / 72).to_numpy()
            return pixels if pixels.ndim == 2 else np.round(pixels[..., :3] @ np.array([0.114, 0.587, 0.299])).astype(np.uint8)
        finally:
            pdf.close()

    return render
