"""Mails at size: headers are parsed once, rows are dealt to all tasks, and texts are those of the library's own policy."""

import email
import email.policy

from corpusmill.plans import files as P
from corpusmill.sources import files as S

SF = "/root/testdata/sf0.001"
ADDRESSES = ("a@example.org", '"John Q" <j@x.org>', "=?utf-8?q?J=C3=BC?= <j@x.org>", "a@b, c@d", "a@b.c (note)", "a..b@c", "a@", "undisclosed:;", "=?a@b", "é@x.org", "x@y\n z")
SUBJECTS = ("About it", "=?utf-8?b?w7w=?= x", "two  blanks", "", "tab\tin", "folded\n line", "äö", "--", "q" * 300)


def mail(number, to, subject):
    return f"From: a@example.org\nTo: {to}\nSubject: {subject}\nDate: Mon,  1 Jan 2024 00:00 GMT\nMIME-Version: 1.0\nContent-Type: text/plain; charset=utf-8\n\nNo. {number}\n".encode()


def by_library(data):
    m = email.message_from_bytes(data, policy=email.policy.default)
    return "\n".join([f"{h}: {m[h]}" for h in ("From", "To", "Subject", "Date") if m[h]] + [m.get_content()])


def test_texts_are_those_of_the_library():
    for k, (a, s) in enumerate((a, s) for a in ADDRESSES for s in SUBJECTS):
        assert S._mail(mail(k, a, s)) == by_library(mail(k, a, s))


def test_headers_in_common_are_parsed_once(monkeypatch):
    parsed, parse = [], email.policy.EmailPolicy.header_fetch_parse
    monkeypatch.setattr(email.policy.EmailPolicy, "header_fetch_parse", lambda self, name, value: parsed.append(name) or parse(self, name, value))
    for k in range(200):
        S._mail(mail(k, f"customer#{k}@example.org", f"About {k}"))
    assert len(parsed) <= 4


def test_rows_are_dealt_to_all_tasks(spark):
    assert P.mail_texts(spark, SF).rdd.getNumPartitions() == 8
