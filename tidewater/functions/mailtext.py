"""Text of messages, file names and server replies as column expressions."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewater.functions import flags as fl

#: The greatest uid; longer numbers in file names wrap to 32 bits, and beyond 64 bits they are this one.
MAX_UID = (1 << 32) - 1


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is worked out once however often it is used; Spark does not see that two lambdas are alike."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _number(digits: Column) -> Column:
    wide = digits.try_cast("decimal(38,0)")
    value = F.when(digits == "", None).when((F.length(F.ltrim(digits, F.lit("0"))) > 20) | (wide > F.lit(str((1 << 64) - 1)).cast("decimal(38,0)")), F.lit(MAX_UID)).otherwise((wide % F.lit(MAX_UID + 1).cast("decimal(38,0)")).cast("long"))
    return value.cast("long")


def uid_of_name(name: Column) -> Column:
    """The number after the first ,U= in a file name; none and 0 are absent."""
    return F.nullif(_number(F.regexp_extract(name, r"(?s)^(?:(?!,U=).)*,U=(\d*)", 1)), F.lit(0).cast("long"))


def letters_of_name(name: Column) -> Column:
    """What follows the first :2, of a file name."""
    return F.regexp_extract(name, r"(?s)^.*?:2,(.*)$", 1)


def base_of_name(name: Column) -> Column:
    return F.substring_index(name, ":2,", 1)


def name_with_flags(name: Column, flags: Column) -> Column:
    """The file name with its flags replaced."""
    return F.concat(base_of_name(name), F.lit(":2,"), fl.to_letters(flags))


def name_with_uid(name: Column, uid: Column, flags: Column) -> Column:
    """The file name with a uid, for a message that had none."""
    return F.concat(base_of_name(name), F.lit(",U="), uid.cast("string"), F.lit(":2,"), fl.to_letters(flags))


def host_label(host: Column) -> Column:
    return F.substring_index(host, ".", 1)


def expanded(path: Column, home: str | None = None) -> Column:
    """The path with a leading ~ replaced by the home folder, the driver's own by default."""
    own = home if home is not None else os.environ.get("HOME", "")
    return F.when(path.startswith("~"), F.concat(F.lit(own), F.substring(path, 2, 1 << 30))).otherwise(path)


def to_lf(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n", "\n")


def to_crlf(text: Column) -> Column:
    return F.regexp_replace(text, "(?<!\r)\n", "\r\n")


def dot_stuffed(text: Column) -> Column:
    return F.regexp_replace(text, r"(^|\n)\.", "$1..")


def append_command(box: Column, flags: Column, message: Column) -> Column:
    """The command that announces an upload, with the exact size that it has with CRLF line ends."""
    return F.concat(F.lit("APPEND "), imap_quoted(box), F.lit(" ("), fl.to_imap(flags), F.lit(") {"), F.octet_length(to_crlf(message)).cast("string"), F.lit("}"))


def smtp_data(message: Column) -> Column:
    """The message as it is submitted: every line ends in CRLF, the last one too, and leading dots are doubled."""
    lines = F.regexp_replace(to_lf(message), r"\r$(?!\n)", "")
    whole = F.when(lines.endswith("\n") | (lines == ""), lines).otherwise(F.concat(lines, F.lit("\n")))
    return F.regexp_replace(dot_stuffed(whole), "\n", "\r\n")


def smtp_commands(sender: Column, recipients: Column) -> Column:
    """The commands of a submission before its data, in order; without a recipient there are none."""
    to = F.transform(recipients, lambda r: F.concat(F.lit("RCPT TO:<"), r, F.lit(">")))
    whole = lambda x: F.concat(F.array(F.concat(F.lit("MAIL FROM:<"), sender, F.lit(">"))), x, F.array(F.lit("DATA")))
    return _once(to, lambda x: F.when(F.size(x) > 0, whole(x)).otherwise(F.array().cast("array<string>")))


def imap_quoted(text: Column) -> Column:
    return F.concat(F.lit('"'), F.regexp_replace(text, r'(["\\])', r"\\$1"), F.lit('"'))


def base64_text(text: Column) -> Column:
    """Base64 in one line, whatever the session's setting for line breaks."""
    return F.translate(F.base64(text.cast("binary")), "\r\n", "")


def unfolded(value: Column) -> Column:
    return F.translate(value, "\r\n", "")


def address_parts(value: Column) -> Column:
    """A header's addresses, split at commas outside quotes."""
    return F.regexp_extract_all(value, F.lit(r'((?:[^",]|"[^"]*(?:"|$))+)'), F.lit(1))


def _inner_text(part: Column) -> Column:
    last = F.length(part) - F.instr(F.reverse(part), "<") + 1
    first = F.instr(part, "<")
    after = F.instr(F.substr(part, first + 1), ">")
    end = F.when(after > 0, first + after).otherwise(0)
    inner = F.when((first > 0) & (end > 0), F.when(end > last, F.substr(part, last + 1, end - last - 1)).otherwise("")).otherwise(part)
    return F.regexp_replace(inner, r"^[ \t]+|[ \t]+$", "")


def one_address(part: Column) -> Column:
    """The text between the last < and the first > after the first <, or all of it; empty is null."""
    return F.nullif(_inner_text(part), F.lit(""))


def addresses(value: Column) -> Column:
    return F.filter(F.transform(address_parts(unfolded(value)), _inner_text), lambda a: a != "")


def head(message: Column) -> Column:
    """The header lines, up to the first blank line."""
    at = F.regexp_instr(message, F.lit(r"(?md)^\r?\n"))
    return F.when(at > 0, F.substring(message, F.lit(1), at - 1)).otherwise(message)


def header_fields(message: Column) -> Column:
    """The header fields in order: name, and value unfolded; lines without a colon count for nothing."""
    own = head(message)
    pattern = F.lit(r"(?md)(?:\A|^(?![ \t]))([^\n:]*):([^\n]*(?:\n[ \t][^\n]*)*)")
    both = F.arrays_zip(F.regexp_extract_all(own, pattern, F.lit(1)).alias("name"), F.regexp_extract_all(own, pattern, F.lit(2)).alias("value"))
    return F.transform(both, lambda f: F.struct(f["name"].alias("name"), unfolded(f["value"]).alias("value")))


def addresses_of(message: Column, *names: str) -> Column:
    """All addresses of the header fields of these names, in their order."""
    return _addresses_in(header_fields(message), *names)


def _addresses_in(fields: Column, *names: str) -> Column:
    own = F.filter(fields, lambda f: F.lower(f["name"]).isin(*names))
    return F.flatten(F.transform(own, lambda f: addresses(f["value"])))


def envelope_sender(given: Column, message: Column, user: Column) -> Column:
    """The sender that was given, else the first From address, else the account's user."""
    return F.coalesce(given, F.get(addresses_of(message, "from"), F.lit(0)), user)


def recipients(message: Column) -> Column:
    return addresses_of(message, "to", "cc", "bcc")


def submission(given: Column, message: Column, user: Column) -> Column:
    """smtp_commands of a message from its envelope_sender to its recipients; its header is taken apart once for both."""
    sender = lambda f: F.coalesce(given, F.get(_addresses_in(f, "from"), F.lit(0)), user)
    return _once(header_fields(message), lambda f: smtp_commands(sender(f), _addresses_in(f, "to", "cc", "bcc")))


def without_bcc(message: Column) -> Column:
    """The message without its Bcc fields and their continuation lines."""
    own = head(message)
    return F.concat(F.regexp_replace(own, r"(?mid)^bcc:[^\n]*(?:\n[ \t][^\n]*)*(?:\n|\z)", ""), F.substr(message, F.length(own) + 1))


def reply_code(lines: Column) -> Column:
    """The code of an SMTP reply: that of its first line that is not continued; without a number 0."""
    last = F.get(F.filter(lines, lambda x: ~((F.length(x) >= 4) & (F.substring(x, 4, 1) == "-"))), F.lit(0))
    return F.coalesce(F.regexp_extract(last, r"^\s*([+-]?\d{1,9})", 1).try_cast("int"), F.lit(0))


def reply_class(lines: Column) -> Column:
    return F.floor(reply_code(lines) / 100).cast("int")


def _last_number(lines: Column, pattern: str, kind: str) -> Column:
    found = F.filter(F.transform(lines, lambda x: F.regexp_extract(x, pattern, 1)), lambda x: x != "")
    return F.coalesce(F.try_element_at(found, F.lit(-1)).try_cast(kind), F.lit(0).cast(kind))


def select_counters(lines: Column) -> dict[str, Column]:
    """The counters that the replies to SELECT give; the last of each counts, and what is not said is 0."""
    return {
        "exists": _last_number(lines, r"^\*\s*(\d+)\s+EXISTS(?:\s|$)", "bigint"),
        "uidvalidity": _last_number(lines, r"^\*\s*OK\s*\[UIDVALIDITY\s*(\d+)", "bigint"),
        "uidnext": _last_number(lines, r"^\*\s*OK\s*\[UIDNEXT\s*(\d+)", "bigint"),
        "modseq": _last_number(lines, r"^\*\s*OK\s*\[HIGHESTMODSEQ\s*(\d+)", "decimal(20,0)"),
    }


def fetched_uid(line: Column) -> Column:
    """The uid of a FETCH reply; null for other lines."""
    uid = F.regexp_extract(line, r"^(?:(?!UID ).)*UID (\d+)", 1)
    return F.when(line.contains(" FETCH "), uid.try_cast("bigint"))


def fetched_flags(line: Column) -> Column:
    """The flags of a FETCH reply; 0 where it has none."""
    at = F.instr(line, "FLAGS (")
    return F.when(at > 0, fl.from_imap(F.substr(line, at))).otherwise(0)


def searched_uids(line: Column) -> Column:
    """The uids of a SEARCH reply, up to the first word that is no number; other lines have none."""
    text = F.trim(F.regexp_extract(line, r"^\* SEARCH((?:\s+\d+)*)", 1))
    return F.when(text == "", F.array().cast("array<bigint>")).otherwise(F.transform(F.split(text, r"\s+"), lambda x: x.try_cast("bigint")))
