"""Opcode decoder: bytes of a script to (symbol, data, end) operations.

Only a few operations change what a script is, so each decoded operation is one
symbol: the letters of ``SYMBOLS``, ``P`` for a push, ``Z`` for an invalid
operation and ``.`` for any other. NOPs are left out."""

from __future__ import annotations

#: Activation height of CHECKLOCKTIMEVERIFY, times of P2SH and segwit.
CLTV_HEIGHT, P2SH_TIME, SEGWIT_TIME = 388381, 1333238400, 1503539857
#: Operations that matter to classification.
SYMBOLS = {0x62: "Y", 0x63: "I", 0x64: "I", 0x67: "E", 0x68: "F", 0x6A: "R", 0x75: "X", 0x76: "D", 0x88: "V", 0xA3: "N", 0xA9: "H", 0xAC: "C", 0xAE: "M"}
#: Bytes that are no operation at all, and disabled ones that end decoding.
INVALID = {0x50, 0x89, 0x8A, *range(0xBA, 0x100)}
DISABLED = {0x65, 0x66, *range(0x7E, 0x82), *range(0x83, 0x87), 0x8D, 0x8E, *range(0x95, 0x9A)}
NOPS = {0x61, 0xB0, *range(0xB2, 0xBA)}
#: Names of operations by byte.
NAMES = dict(
    enumerate(
        """NOP VER IF NOTIF VERIF VERNOTIF ELSE ENDIF VERIFY RETURN TOALTSTACK FROMALTSTACK 2DROP 2DUP 3DUP 2OVER 2ROT 2SWAP
        IFDUP DEPTH DROP DUP NIP OVER PICK ROLL ROT SWAP TUCK CAT SUBSTR LEFT RIGHT SIZE INVERT AND OR XOR EQUAL EQUALVERIFY
        RESERVED1 RESERVED2 1ADD 1SUB 2MUL 2DIV NEGATE ABS NOT 0NOTEQUAL ADD SUB MUL DIV MOD LSHIFT RSHIFT BOOLAND BOOLOR
        NUMEQUAL NUMEQUALVERIFY NUMNOTEQUAL LESSTHAN GREATERTHAN LESSTHANOREQUAL GREATERTHANOREQUAL MIN MAX WITHIN RIPEMD160
        SHA1 SHA256 HASH160 HASH256 CODESEPARATOR CHECKSIG CHECKSIGVERIFY CHECKMULTISIG CHECKMULTISIGVERIFY""".split(),
        start=0x61,
    )
)
NAMES[0xB1] = "CHECKLOCKTIMEVERIFY"


def _push(script: bytes, i: int) -> tuple[bytes, int] | None:
    """(data, end) of the push at i, or None where its bytes run short."""
    b = script[i]
    if b == 0x4F:
        return b"\x81", i + 1
    if 0x51 <= b <= 0x60:
        return bytes([b - 0x50]), i + 1
    wide = {0x4C: 1, 0x4D: 2, 0x4E: 4}.get(b, 0)
    start = i + 1 + wide
    size = int.from_bytes(script[i + 1 : start], "little") if wide else b
    return (script[start : start + size], start + size) if start + size <= len(script) else None


def decode(script: bytes, height: int) -> tuple[list[tuple[str, bytes | None, int, int]], bool]:
    """Operations as (symbol, pushed data, end, byte), and whether decoding reached the end."""
    ops, i = [], 0
    while i < len(script):
        b = script[i]
        if b <= 0x4F or 0x51 <= b <= 0x60:
            got = _push(script, i)
            if got is None:
                return ops, False
            ops.append(("P", got[0], got[1], b))
            i = got[1]
            continue
        i += 1
        if b in DISABLED:
            return ops, False
        if b in NOPS or (b == 0xB1 and height < CLTV_HEIGHT):
            continue
        ops.append(("Z" if b in INVALID else SYMBOLS.get(b, "."), None, i, b))
    return ops, True


def op_name(symbol: str, byte: int) -> str:
    return "OP_PUSH" if symbol == "P" else "OP_INVALID" if symbol == "Z" else f"OP_{NAMES[byte]}"


#: Scripts fewer than so many are decoded one by one.
FEW = 32


def tally(scripts, heights) -> dict[str, int]:
    """How often each operation (``op_name``) is in the scripts of an Arrow array; NOPs are left out.

    All scripts are stepped through at once, an operation a step, as ``decode`` does it."""
    import numpy as np
    import pyarrow.compute as pc

    known = scripts.is_valid()
    scripts, late = scripts.filter(known), pc.fill_null(pc.greater_equal(heights.filter(known), CLTV_HEIGHT), False).to_numpy(zero_copy_only=False)
    size = np.zeros(256, np.int64)
    size[:0x4C] = range(0x4C)
    width = np.zeros(256, np.int64)
    width[[0x4C, 0x4D, 0x4E]] = 1, 2, 4
    push, disabled, nop = np.zeros((3, 256), bool)
    push[[*range(0x50), *range(0x51, 0x61)]] = True
    disabled[list(DISABLED)] = True
    nop[list(NOPS)] = True
    counts = np.zeros(256, np.int64)
    if len(scripts):
        ends = np.frombuffer(scripts.buffers()[1], np.int32)[scripts.offset : scripts.offset + len(scripts) + 1].astype(np.int64)
        data = np.frombuffer(scripts.buffers()[2] or b"", np.uint8)
        at, end = ends[:-1], ends[1:]
        while True:
            on = at < end
            at, end, late = at[on], end[on], late[on]
            if len(at) < FEW:
                break
            b = data[at]
            after, wide = at + 1 + width[b], width[b] > 0
            fits = after <= end
            length = size[b]
            if wide.any():
                for i in range(4):
                    here = fits & (width[b] > i)
                    length[here] += data[at[here] + 1 + i].astype(np.int64) << 8 * i
            after += length
            goes = np.where(push[b], fits & (after <= end), ~disabled[b])
            told = goes & ~nop[b] & ((b != 0xB1) | late)
            counts += np.bincount(b[told], minlength=256)
            at, end, late = after[goes], end[goes], late[goes]
        for i in range(len(at)):
            for _, _, _, byte in decode(data[at[i] : end[i]].tobytes(), CLTV_HEIGHT if late[i] else 0)[0]:
                counts[byte] += 1
    out: dict[str, int] = {}
    for byte in np.flatnonzero(counts).tolist():
        name = op_name("P" if push[byte] else "Z" if byte in INVALID else ".", byte)
        out[name] = out.get(name, 0) + int(counts[byte])
    return out
