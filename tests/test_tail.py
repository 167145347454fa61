"""Following growing files, in batch and as a stream that is started again."""

import io

import pytest

from seclog.sources import files, tail
from seclog.streaming import queries


def brute(path, start, end):
    data, found, at = path.read_bytes()[:end], [], start
    while (stop := data.find(b"\n", at)) >= 0:
        found.append((at, data[at:stop].decode()))
        at = stop + 1
    return found


@pytest.mark.parametrize("split", [1, 7, 64, 10**6])
def test_batch_gives_every_whole_line_once(spark, tmp_path, split):
    """New files, growing files, a line without its end, a replaced file, one that grew by nothing but a part."""
    a, b = tmp_path / "logs" / "a.log", tmp_path / "logs" / "sub" / "b.log"
    b.parent.mkdir(parents=True)
    seen = None

    def look():
        nonlocal seen
        lines, seen = tail.appended_lines(spark, str(tmp_path / "logs"), seen, split)
        return sorted(r.line for r in lines.collect())

    assert look() == []
    a.write_text("one\ntwo\nthr")
    assert look() == ["one", "two"]
    assert look() == []
    with a.open("a") as f:
        f.write("ee\n\nfour é\n")
    b.write_text("five\n")
    assert look() == ["", "five", "four é", "three"]
    with a.open("a") as f:
        f.write("six\n")
    b.write_text("x\n")
    assert look() == ["six", "x"]
    b.write_text("y\n")  # as long as before, with another beginning
    assert look() == ["y"]
    assert look() == []
    b.unlink()
    assert look() == []
    b.write_text("y\n")
    assert look() == ["y"]


def test_ranges_share_out_all_lines(tmp_path):
    log = tmp_path / "a.log"
    log.write_bytes(b"\n\nfirst\n" + b"long " * 300 + b"\n" + "é\n".encode() * 40 + b"last\nunfinished")
    end = tail.last_line_end(tail.store_of(str(log))[0], str(log), log.stat().st_size)
    assert log.read_bytes()[end:] == b"unfinished"
    for first in (0, 2, 8):
        for split in (1, 2, 3, 50, 5000):
            found = []
            for lo in range(first, end, split):
                part = tail.ByteRange(str(log), str(log), lo, min(lo + split, end), first, end)
                with log.open("rb") as f:
                    found += [(at, line.decode()) for at, line in tail.lines_in(f, part)]
            assert found == brute(log, first, end)


class Counted(io.BytesIO):
    taken = 0

    def read(self, n=-1):
        got = super().read(n)
        self.taken += len(got)
        return got


def test_only_new_bytes_are_read(tmp_path):
    """10 MB known, 20 bytes new: 20 bytes are read, and the file's head and end are looked at once."""
    log = tmp_path / "a.log"
    log.write_bytes(b"0123456789abcde\n" * 655_360)
    before = tail.places_now(str(tmp_path), {})
    with log.open("ab") as f:
        f.write(b"one more\nand another")
    now = tail.places_now(str(tmp_path), before)
    (part,) = tail.ranges_between(str(tmp_path), before, now, tail.SPLIT_BYTES)
    assert (part.lo, part.hi) == (16 * 655_360, 16 * 655_360 + 9)
    counted = Counted(log.read_bytes())
    assert [x for _, x in tail.lines_in(counted, part)] == [b"one more"] and counted.taken == 9
    assert tail.places_now(str(tmp_path), now)[str(log)] is now[str(log)]  # not opened


def test_stream_goes_on_after_a_restart(spark, tmp_path):
    source, out = tmp_path / "logs", str(tmp_path / "out")
    source.mkdir()
    log = source / "syslog"

    def go(frame):
        started = queries.start_table(frame, f"{out}/t", f"{out}/c", every=None)
        started.awaitTermination()
        return sorted(r[0] for r in spark.read.parquet(f"{out}/t").select("message").collect())

    log.write_bytes(b"\xef\xbb\xbffirst\nsec")
    follow = lambda: files.follow_logs(spark, str(source), "lubuntu", growing=True)
    assert go(follow()) == ["first"]
    with log.open("a") as f:
        f.write("ond\nthird\nfour")
    (source / "auth.log").write_text("other\n")
    assert go(follow()) == ["first", "other", "second", "third"]
    assert go(follow()) == ["first", "other", "second", "third"]
    rows = spark.read.parquet(f"{out}/t").select("message", "log_source", "topic").collect()
    assert ("other", "auth", "lubuntu_auth") in set(map(tuple, rows))


def test_parsed_stream_of_a_growing_file(spark, tmp_path):
    from seclog import fixed_values as fv

    source, out = tmp_path / "logs", str(tmp_path / "out")
    source.mkdir()
    (source / "a.log").write_text("2024-01-02 03:04:05 INFO it began\nnot a line of that form\n")
    for more in ("", "2024-01-02 03:04:06 ERROR it ended\n"):
        with (source / "a.log").open("a") as f:
            f.write(more)
        queries.start_table(files.follow_parsed_log(spark, str(source), growing=True),
                            f"{out}/t", f"{out}/c", every=None).awaitTermination()
    whole = files.parse_tailed(spark.read.text(str(source)))
    assert fv.TAILED_LINE and whole.count() > 0
    assert spark.read.parquet(f"{out}/t").exceptAll(whole).isEmpty() and whole.exceptAll(
        spark.read.parquet(f"{out}/t")).isEmpty()
