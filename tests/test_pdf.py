import zlib

from leafmill.operators import pdf as P
from leafmill.sources.pdf import predicted, read_pdfs, run_length


def make(pages, compress=True):
    """A small PDF of content streams, without a cross-reference table."""
    out = [b"%PDF-1.7\n1 0 obj\n<< /Type /Catalog /Pages 2 0 R >>\nendobj\n"]
    kids = " ".join(f"{10 + 2 * k} 0 R" for k in range(len(pages)))
    out.append(f"2 0 obj\n<< /Type /Pages /Kids [{kids}] /Count {len(pages)} /MediaBox [0 0 600 800] /Resources << /Font << /F1 3 0 R /F2 4 0 R >> >> >>\nendobj\n".encode())
    out.append(b"3 0 obj\n<< /Type /Font /Subtype /Type1 /BaseFont /Times-Roman >>\nendobj\n4 0 obj\n<< /Type /Font /Subtype /Type1 /BaseFont /Courier >>\nendobj\n")
    for k, content in enumerate(pages):
        data = zlib.compress(content.encode("latin-1")) if compress else content.encode("latin-1")
        f = "/Filter /FlateDecode " if compress else ""
        out.append(f"{10 + 2 * k} 0 obj\n<< /Type /Page /Parent 2 0 R /Contents {11 + 2 * k} 0 R >>\nendobj\n{11 + 2 * k} 0 obj\n<< {f}/Length {len(data)} >>\nstream\n".encode() + data + b"\nendstream\nendobj\n")
    return b"".join(out) + b"trailer << /Root 1 0 R >>\n%%EOF"


def text(x, y, s, size=10, font="F1"):
    return f"BT /{font} {size} Tf 1 0 0 1 {x} {y} Tm ({s}) Tj ET\n"


def test_blocks_and_margins(spark):
    page = lambda n: text(50, 780, f"Running head {n}") + text(50, 700, "A heading", 18) + text(50, 670, "First line of a para-") + text(50, 658, "graph that goes on.") + text(50, 620, "code here", 10, "F2") + text(50, 590, "1. an item")
    files = spark.createDataFrame([("a", make([page(1), page(2), page(3)])), ("b", b"junk"), ("c", make(["/x"]).replace(b"trailer <<", b"trailer << /Encrypt 9 0 R")), ("d", None)], "path string, content binary")
    spans = read_pdfs(files)
    status = {r.path: r.status for r in spans.select("path", "status").distinct().collect()}
    assert status == {"a": "ok", "b": "invalid: ValueError", "c": "encrypted", "d": "invalid: ValueError"}
    blocks = P.document(spans.where("status = 'ok'"))
    got = [(r.role, r.text) for r in blocks.where("page = 1").orderBy("block").collect()]
    assert got == [("heading", "A heading"), ("text", "First line of a paragraph that goes on."), ("code", "code here"), ("list", "1. an item")]
    assert "# A heading" in P.markdown(blocks).first().markdown
    assert {r.path: r.pages for r in P.statistics(spans, blocks).collect()}["a"] == 3


def test_columns_and_tables(spark):
    two = "".join(text(50, 700 - 12 * k, f"left {k}") + text(350, 700 - 12 * k, f"right {k}") for k in range(4))
    table = "50 400 200 40 re S 50 420 m 250 420 l S 150 400 m 150 440 l S\n" + text(60, 425, "a") + text(160, 425, "b") + text(60, 405, "c") + text(160, 405, "d")
    spans = read_pdfs(spark.createDataFrame([("x", make([two], False)), ("t", make([table]))], "path string, content binary"))
    order = [r.text for r in P.column_order(P.classify(P.lines(spans.where("path = 'x'")), P.body_size(spans))).orderBy("flow").collect()]
    assert order == [f"left {k}" for k in range(4)] + [f"right {k}" for k in range(4)]
    assert [(r.row, r.col, r.text) for r in P.ruled_tables(spans.where("path = 't'")).orderBy("row", "col").collect()] == [(0, 0, "a"), (0, 1, "b"), (1, 0, "c"), (1, 1, "d")]


def test_filters():
    assert run_length(bytes([2, 65, 66, 67, 254, 68, 128])) == b"ABCDDD"
    assert predicted(bytes([2, 1, 2, 2, 1, 1]), {"/Predictor": 12, "/Columns": 2}) == bytes([1, 2, 2, 3])
    assert predicted(bytes([1, 1, 1, 4, 1, 1]), {"/Predictor": 15, "/Columns": 2})[:2] == bytes([1, 2])
