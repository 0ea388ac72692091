import io
import zipfile

from talkloom.sources import docx, vtt

_W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def document(lines):
    body = "".join(f"<w:p><w:r><w:t>{x}</w:t></w:r></w:p>" for x in lines)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{_W}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_docx_headers_carry_to_their_lines(spark):
    files = spark.createDataFrame([("a", document(["Title", "Jan Novak  0:05", "Hello.", "Petra  1:00:10", "Yes.", "No."])), ("b", b"junk")], "media_id string, content binary")
    got = [tuple(r)[2:] for r in docx.parse(files).orderBy("i").collect()]
    assert got == [("Jan Novak", "Hello.", 5000, 65000), ("Petra", "Yes.", 3610000, 3610500), ("Petra", "No.", 3610000, 3615000)]


def test_vtt_quirks(spark):
    text = "﻿WEBVTT\r\n\r\ncue-1\r\n00:00:01.000 --> 00:00:02,500\r\n<v A &amp; B>One</v><v C<x>>Two</v>\r\n\r\nnote only\r\n\r\n00:00:03.000 --> 00:00:04.000\r\nplain &lt;b&gt;\r\n\r\n00:00:05.000 --> 00:00:06.000\r\n<v D></v>\r\n"
    got = [tuple(r)[1:] for r in vtt.parse(spark.createDataFrame([("m", text)], "media_id string, value string")).orderBy("cue_idx").collect()]
    assert got[0] == (0, "A & B", "One", 1000, 2500)
    assert got[-1] == (2, "", "plain <b>", 3000, 4000) and len(got) == 3
