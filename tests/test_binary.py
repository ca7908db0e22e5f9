"""Binary recording imports (fixtures written here with struct)."""

import struct

from eventlake.sources import binary


def _spk(path, chans, duration=1000):
    n = len(chans)
    head = struct.pack("<4sII", b"SPK1", n, duration)
    off = 12 + 12 * n
    index, body = b"", b""
    for ts in chans:
        index += struct.pack("<QI", off + len(body), len(ts))
        body += struct.pack(f"<{len(ts)}I", *ts)
    path.write_bytes(head + index + body)


def test_spk_roundtrip_and_bad_magic(spark, tmp_path):
    d = tmp_path / "rec"
    d.mkdir()
    _spk(d / "a.spk", [[1, 5, 9], [], [3]])
    (d / "b.spk").write_bytes(b"NOPE" + b"\0" * 20)
    whole = (d / "a.spk").read_bytes()
    (d / "c.spk").write_bytes(whole[:30])                                      # index cut off
    (d / "d.spk").write_bytes(whole[:-2])                                      # last times cut off
    (d / "e.spk").write_bytes(struct.pack("<4sII", b"SPK1", 1, 9) + struct.pack("<QI", 1 << 60, 1 << 31))
    (d / "f.spk").write_bytes(b"SP")
    ev, rej = binary.read_spk(spark, str(d))
    got = sorted((r.channel, r.t) for r in ev.collect())
    assert got == [(0, 1), (0, 5), (0, 9), (2, 3)]
    assert sorted(r.status for r in rej.collect()) == ["bad_index", "bad_index", "bad_magic", "short_file", "short_index"]


def test_spkl_torn_tail_and_dropped_channels(spark, tmp_path):
    d = tmp_path / "log"
    d.mkdir()
    recs = [(2, 50), (0, 10), (9, 11), (1, 10)]
    (d / "x.spkl").write_bytes(b"".join(struct.pack("<II", c, t) for c, t in recs) + b"\x01\x02\x03")
    ev, rep = binary.read_spkl(spark, str(d), n_channels=4)
    assert [(r.t, r.channel) for r in ev.collect()] == [(10, 0), (10, 1), (50, 2)]
    assert [(r.status, r.dropped) for r in rep.collect()] == [("dropped_channel", 1)]
