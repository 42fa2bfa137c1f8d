import os

import pytest

from surveylens.sources import readers


def folder(tmp_out, **files):
    for name, text in files.items():
        with open(os.path.join(tmp_out, name + ".csv"), "w", encoding="utf-8", newline="") as f:
            f.write(text)
    return tmp_out


@pytest.mark.parametrize("text,sep,columns,rows", [
    ('"a,b";c\n1;2\n', ";", ["a,b", "c"], [(1, 2)]),
    ('a\t"x;y;z"\n1\t"p;q"\n', "\t", ["a", "x;y;z"], [(1, "p;q")]),
    ('a,b\n"1,5;2;3",2\n"4;5;6;7",3\n', ",", ["a", "b"], [("1,5;2;3", 2), ("4;5;6;7", 3)]),
    ('a,b\n"say ""hi"", you",2\n', ",", ["a", "b"], [('say "hi", you', 2)]),
    ('a;b\n"two\nlines; here";2\nx;3\n', ";", ["a", "b"], [("two\nlines; here", 2), ("x", 3)]),
    ("a;b;c\n1,5;2,5;x\n", ";", ["a", "b", "c"], [("1,5", "2,5", "x")]),
    ("﻿a,b\n1,2\n", ",", ["a", "b"], [(1, 2)]),
    ("a\n1\n", ",", ["a"], [(1,)]),
])
def test_delimiters_and_quotes(spark, tmp_out, text, sep, columns, rows):
    path = folder(tmp_out, one=text)
    assert readers.sniff_delimiter(spark, path) == sep
    out = readers.read_delimited(spark, path)
    assert out.columns == columns and [tuple(r) for r in out.collect()] == rows


def test_files_that_differ_raise(spark, tmp_out):
    path = folder(tmp_out, a="x;y\n1;2\n", b="x,y\n3,4\n")
    with pytest.raises(Exception, match="(?i)header"):
        readers.read_delimited(spark, path, infer=False).collect()


def test_records_cut_off_by_the_head_do_not_count(spark, tmp_out, monkeypatch):
    monkeypatch.setattr(readers, "HEAD_BYTES", 21)
    path = folder(tmp_out, a="x;y\n1;2\n" + "3;4\n" * 50)
    assert readers.sniff_format(spark, path) == (";", False)
