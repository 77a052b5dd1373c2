"""Office documents, section trees, the registry and SQL functions."""

import io
import zipfile

import pytest

from quire.operators.documents import fragments, markers_of, read_docx, read_docx_styles
from quire.registry import Registry, Spec, register_functions
from quire.sources import ast

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def docx(paragraphs, styles=""):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        body = "".join(f'<w:p><w:pPr><w:pStyle w:val="{s}"/></w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>' for s, t in paragraphs)
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
        if styles:
            z.writestr("word/styles.xml", f"<w:styles {W}>{styles}</w:styles>")
    return buf.getvalue()


def test_docx(spark, tmp_path):
    style = '<w:style w:type="paragraph" w:styleId="H1"><w:name w:val="heading 1"/><w:pPr><w:outlineLvl w:val="0"/></w:pPr></w:style><w:style w:type="character" w:styleId="c"/>'
    (tmp_path / "a.docx").write_bytes(docx([("H1", "标题"), ("Normal", "正文")], style))
    (tmp_path / "b.docx").write_bytes(docx([]))
    rows = read_docx(spark, str(tmp_path)).orderBy("pos").collect()
    assert [(r.style, r.text) for r in rows] == [("H1", "标题"), ("Normal", "正文")]
    assert [(r.style_id, r.name, r.outline_level) for r in read_docx_styles(spark, str(tmp_path)).collect()] == [("H1", "heading 1", 0.0)]


def test_section_tree(spark, tmp_path):
    rows = [("b", "sec_001", "T", 1, "x\n\ny", [("sec_001_p001", "x", "", False)])]
    df = spark.createDataFrame(rows, ast.SECTION)
    ast.write_json(df, str(tmp_path / "j"))
    assert ast.read_json(spark, str(tmp_path / "j")).collect() == df.collect()
    ast.write_markdown(df, str(tmp_path / "m"))
    assert [(r.book, r.text) for r in ast.read_markdown(spark, str(tmp_path / "m")).collect()] == [("b", "x\n\ny\n\n")]


@pytest.mark.parametrize("text,want", [("a①b", [("①", 1, 1, 2)]), ("x¹² [ 3 ]", [("¹²", 12, 1, 3), ("[ 3 ]", 3, 4, 9)]), ("结束b。", [("b", 2, 2, 3)]), ("2012", []), ("", [])])
def test_markers(text, want):
    assert [m[:4] for m in markers_of(text)] == want


def test_fragments():
    assert fragments("abc", "abc") == ([], [], [])
    assert fragments("abc", "ac") == (["b"], [], [])
    assert fragments("ac", "abc") == ([], ["b"], [])
    assert fragments("abc", "axc") == ([], [], ["b -> x"])


def test_registry(spark):
    r = Registry()
    r.register(Spec("b", None, order=2))
    r.register(Spec("a", None, order=1))
    r.register(Spec("c", None, enabled=False))
    with pytest.raises(ValueError):
        r.register(Spec("a", None))
    assert [s.name for s in r.specs()] == ["a", "b"] and r.unregister("c") and not r.unregister("c")
    register_functions(spark)
    assert spark.sql("SELECT marker, number FROM detect_markers('甲①')").collect()[0].number == 1
