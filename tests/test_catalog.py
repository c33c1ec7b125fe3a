"""The company catalog as XML and as a zip."""

import io
import zipfile

import pytest

from ledgerline.sources import files, paged

XML = "<result><list><corp_code>00000001</corp_code><corp_name> 가나 </corp_name><corp_eng_name>A</corp_eng_name><stock_code>005930</stock_code><modify_date>20240101</modify_date></list><list><corp_code>x</corp_code><corp_name>b</corp_name></list></result>"


def _zip(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in members:
            z.writestr(name, text)
    return out.getvalue()


def test_zip_and_xml_have_the_same_rows(spark, tmp_path):
    (tmp_path / "c.xml").write_text(XML)
    (tmp_path / "c.zip").write_bytes(_zip([("CORPCODE.xml", XML)]))
    rows = [sorted(tuple(r) for r in files.catalog_rows(files.read_catalog(spark, str(tmp_path / n))).collect()) for n in ("c.xml", "c.zip")]
    assert rows[0] == rows[1] == [("00000001", "가나", "A", "005930", "20240101")]


def test_answers_in_place_of_a_catalog():
    assert files.catalog_xml(_zip([("a.xml", XML)])).decode() == XML
    for raw, error in ((b"<result><status>020</status></result>", paged.QuotaError), (b"<result><status>013</status></result>", paged.SourceError), (b"junk", paged.SourceError), (_zip([]), paged.SourceError), (_zip([("a.xml", "x"), ("b.xml", "y")]), paged.SourceError)):
        with pytest.raises(error):
            files.catalog_xml(raw)
