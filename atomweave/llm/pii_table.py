"""The labelled table of the personal-data field: lines written by hand, with each span as {kind|words}.

The kinds are those of pii.EXTRA. Lookalikes that are no personal data, and forms that the base patterns find by
themselves, stand unlabelled. lines() makes the training rows: every line several times, its digits drawn anew, sometimes
beside another line.
"""

from __future__ import annotations

import re

import numpy as np

TABLE = """
write to {email|alice at example dot com} please
you can reach {email|maria.lopez at northmail dot org} any day
send the file to {email|j.smith at web3 dot net}, thanks
my address is {email|bob at mail dot com}
{email|karl at example1 dot com} is the contact
questions go to {email|info at harbour dot org} or the desk
Ask {email|Anna.Berg at uni dot net} about the lecture.
we wrote {email|hr at corp dot com} twice
for orders use {email|sales at shop9 dot com}
{email|eva at host dot net}
reply by mail to {email|team.lead at office dot com} before noon
Her new one: {email|t.o at k dot org}.
the sender was {email|noreply at lists dot net} again
contact {email|peter at small dot com} , he knows
email {email|olga.k at inbox7 dot org} and wait
Bitte an {email|hans at post dot net} senden
escriba a {email|luis at correo dot com} hoy
mail: {email|ma at an dot org}
call me at {phone|555-123-4567} after six
the number is {phone|(415) 555-0133}, ask for Tom
phone {phone|212-555-0199}
Fax {phone|(202) 555-0147} or come by
tel {phone|303-555-0100}, weekdays
reach the desk on {phone|(617) 555-0162}
{phone|718-555-0123}
{phone|(312) 555-0188} rings at home
Text {phone|646-555-0111} now
mobile {phone|808-555-0175} and nothing else
her line, {phone|(503) 555-0129}, is busy
dial {phone|919-555-0140} then wait
Tel. {phone|(214) 555-0118}
we called {phone|404-555-0156} , nobody there
llame al {phone|305-555-0194} antes
ruf {phone|(720) 555-0182} an
my number is {national_id|123-45-6789} ok
ssn {national_id|078-05-1120}
Social security {national_id|219-09-9999} was on the form
the insurance number {national_id|457-55-5462} leaked
{national_id|987-65-4321}
id {national_id|321-54-9876}, born here
he typed {national_id|111-22-3333} by mistake
SSN: {national_id|536-90-4399}.
number {national_id|600-12-3456} belongs to her
su seguro {national_id|252-63-1478} consta
meet at the station at 7 dot
we met at noon and left at 5
look at line 12 and at 30
at home there was a dot
the dot at the end of a line
he works at example and lives here
a dot product of two rows
arrive at gate 22 before nine
la mi no at ra te dot
the night at host was long
stop at kilo 40 dot
date 2024-01-31 was a Wednesday
from 1999-12-31 to 2000-01-01
on 03-04-2021 we moved
due 12/05/2023 at noon
version 1.2.3 of the tool
release 10.4.12 fixes it
section 3.2 and 4.7
about 45% of it
in the year (1984) they met
(2020) was the edition
code 555-123 opens it
room 212-555 is free
pages 12-15 and 101-203
score 3-1 at half time
lines 5-9 hold it
part 123-45 is missing
item 123-45-6789-10 is out of stock
order 1234-567-8901 has shipped
batch 99-88-7766 was late
serial 555-12-4567-89 no longer valid
group 12-345-6789 came
it took 12:34:56 in all
at 09:15:00 sharp
22 333 44 were the digits
we counted 12 345 67 of them
total 1234567890 bytes
number 4155550133 stands alone
pi is 3.14159
call 7 of them
phone 3 was new
ssn is a short word
social security is an institution
insurance costs 120 a month
the email list has 200 names
mail went out on 5 May
fax machines of 1990
host 10.0.0.1 answered
server 192.168.0.12 at port 8080
address 224.145.138.68 was blocked
999.1.1.1 is no address
mask 255.255.255.0
123.45.678.90 looks odd
mail a.b12@site.com to join
ask x.y@place.org or @handle
@name wrote first
see user.33@mail.com and reply
+1 (771) 555-1655 rings
+44 (020) 555-0199 rings
call +1 (202) 555-0147 abroad
card 4111 1111 1111 1111 expired
4111-1111-1111-1111 was declined
5500 0000 0000 0004 is a test number
key = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"
token = "a3f5c9e0b1d24876a3f5c9e0b1d24876a3f5c9e0"
hash = "00112233445566778899aabbccddeeff00112233"
x = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4"
nothing here at all
la mi no te ra
Nada de esto es un dato, dijo.
Das ist nur ein Satz, mehr nicht.
C'est une phrase de plus.
HEA ONONAT TO THE ANOR ERONNTEN ONNT
THE TITLE AT THE TOP
A. B. Clark and C. Dunn wrote it
she said: come, wait (please), go!
The END. Of 3 parts, this is 1.
""".strip().split("\n")

SPAN = re.compile(r"\{(\w+)\|([^}]*)\}")


def labelled(line: str, words: re.Pattern) -> tuple[list[str], list[str]]:
    """(words, labels) of a line of the table."""
    out: list[str] = []
    labels: list[str] = []
    at = 0
    for m in [*SPAN.finditer(line), None]:
        rest = words.findall(line[at : m.start() if m else len(line)])
        out += rest
        labels += ["O"] * len(rest)
        if m:
            own = words.findall(m[2])
            out += own
            labels += [f"B-{m[1]}", *[f"I-{m[1]}"] * (len(own) - 1)]
            at = m.end()
    return out, labels


def lines(words: re.Pattern, times: int = 6, seed: int = 11) -> list[tuple[list[str], list[str]]]:
    """Training rows: each line of the table as often as times says, digits drawn anew, from the second on with capitals at times and another line before or after it."""
    rng = np.random.default_rng(seed)
    table = [labelled(x, words) for x in TABLE]
    out = []
    for k in range(times):
        for own, labels in table:
            if k and rng.random() < 0.5:
                other, more = table[rng.integers(len(table))]
                own, labels = (own + other, labels + more) if rng.random() < 0.5 else (other + own, more + labels)
            own = ["".join(str(rng.integers(10)) if c in "0123456789" else c for c in w) for w in own]
            out.append(([w.capitalize() if k and w.islower() and rng.random() < 0.1 else w for w in own], labels))
    return out
