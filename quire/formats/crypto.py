"""Ciphers and keys of encrypted PDF files: RC4, AES in CBC and ECB, and the standard security handler.

From the published standards: FIPS 197, and ISO 32000 for revisions 2 to 6.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass


def rc4(key: bytes, data: bytes) -> bytes:
    s, j = list(range(256)), 0
    for i in range(256):
        j = (j + s[i] + key[i % len(key)]) % 256
        s[i], s[j] = s[j], s[i]
    out, i, j = bytearray(), 0, 0
    for b in data:
        i = (i + 1) % 256
        j = (j + s[i]) % 256
        s[i], s[j] = s[j], s[i]
        out.append(b ^ s[(s[i] + s[j]) % 256])
    return bytes(out)


def _times(a: int, b: int) -> int:
    """Product in the field of 256 elements of AES."""
    out = 0
    while b:
        if b & 1:
            out ^= a
        a = (a << 1) ^ (0x11B if a & 0x80 else 0)
        b >>= 1
    return out


def _affine(x: int) -> int:
    out = 0x63
    for turn in range(5):
        out ^= (x << turn | x >> (8 - turn)) & 0xFF
    return out


def _inverses() -> list[int]:
    """Inverses in the field, by powers of 3, which reach every element but 0."""
    powers = [1]
    while len(powers) < 255:
        powers.append(_times(powers[-1], 3))
    out = [0] * 256
    for n, x in enumerate(powers):
        out[x] = powers[-n % 255]
    return out


SBOX = [_affine(x) for x in _inverses()]
UNSBOX = [SBOX.index(i) for i in range(256)]
BY = {n: [_times(x, n) for x in range(256)] for n in (2, 3, 9, 11, 13, 14)}


class Aes:
    """The block cipher with a key of 16, 24 or 32 bytes."""

    def __init__(self, key: bytes):
        n = len(key) // 4
        words, rcon = [list(key[4 * i : 4 * i + 4]) for i in range(n)], 1
        for i in range(n, 4 * (n + 7)):
            w = list(words[-1])
            if i % n == 0:
                w = [SBOX[b] for b in w[1:] + w[:1]]
                w[0] ^= rcon
                rcon = _times(rcon, 2)
            elif n > 6 and i % n == 4:
                w = [SBOX[b] for b in w]
            words.append([a ^ b for a, b in zip(words[i - n], w, strict=True)])
        flat = [b for w in words for b in w]
        self.keys = [flat[16 * r : 16 * r + 16] for r in range(n + 7)]

    def encrypt_block(self, block: bytes) -> bytes:
        s = [a ^ k for a, k in zip(block, self.keys[0], strict=True)]
        for r, key in enumerate(self.keys[1:], 1):
            s = [SBOX[s[(i + 4 * (i % 4)) % 16]] for i in range(16)]
            if r < len(self.keys) - 1:
                s = [BY[2][s[4 * c + i]] ^ BY[3][s[4 * c + (i + 1) % 4]] ^ s[4 * c + (i + 2) % 4] ^ s[4 * c + (i + 3) % 4] for c in range(4) for i in range(4)]
            s = [a ^ k for a, k in zip(s, key, strict=True)]
        return bytes(s)

    def decrypt_block(self, block: bytes) -> bytes:
        s = [a ^ k for a, k in zip(block, self.keys[-1], strict=True)]
        for r in range(len(self.keys) - 2, -1, -1):
            s = [UNSBOX[s[(i - 4 * (i % 4)) % 16]] for i in range(16)]
            s = [a ^ k for a, k in zip(s, self.keys[r], strict=True)]
            if r:
                s = [BY[14][s[4 * c + i]] ^ BY[11][s[4 * c + (i + 1) % 4]] ^ BY[13][s[4 * c + (i + 2) % 4]] ^ BY[9][s[4 * c + (i + 3) % 4]] for c in range(4) for i in range(4)]
        return bytes(s)


def cbc_encrypt(key: bytes, iv: bytes, data: bytes, pad: bool = True) -> bytes:
    if pad:
        n = 16 - len(data) % 16
        data += bytes([n] * n)
    cipher, out, last = Aes(key), [], iv
    for i in range(0, len(data), 16):
        last = cipher.encrypt_block(bytes(a ^ b for a, b in zip(data[i : i + 16], last, strict=True)))
        out.append(last)
    return b"".join(out)


def cbc_decrypt(key: bytes, iv: bytes, data: bytes, pad: bool = True) -> bytes:
    cipher, out, last = Aes(key), [], iv
    for i in range(0, len(data), 16):
        block = data[i : i + 16]
        out.append(bytes(a ^ b for a, b in zip(cipher.decrypt_block(block), last, strict=True)))
        last = block
    plain = b"".join(out)
    return plain[: -plain[-1]] if pad and plain and 1 <= plain[-1] <= 16 else plain


#: Fixed value: what passwords are filled up with.
PAD = bytes.fromhex("28bf4e5e4e758a4164004e56fffa01082e2e00b6d0683e802f0ca9fe6453697a")


class WrongPassword(ValueError):
    pass


@dataclass
class Encryption:
    revision: int
    key_bytes: int
    owner: bytes
    user: bytes
    permissions: int
    file_id: bytes
    owner_key: bytes = b""
    user_key: bytes = b""
    metadata: bool = True


def padded(password: bytes) -> bytes:
    return (password + PAD)[:32]


def _turned(key: bytes, n: int) -> bytes:
    return bytes(b ^ n for b in key)


def early_key(password: bytes, e: Encryption) -> bytes:
    """Revisions 2 to 4: the file key of a user password."""
    tail = b"" if e.revision < 4 or e.metadata else b"\xff\xff\xff\xff"
    key = hashlib.md5(padded(password) + e.owner[:32] + (e.permissions & 0xFFFFFFFF).to_bytes(4, "little") + e.file_id + tail).digest()
    size = 5 if e.revision == 2 else e.key_bytes
    for _ in range(50 if e.revision > 2 else 0):
        key = hashlib.md5(key[:size]).digest()
    return key[:size]


def early_user(key: bytes, e: Encryption) -> bytes:
    """What the user entry must begin with for that key."""
    if e.revision == 2:
        return rc4(key, PAD)
    value = hashlib.md5(PAD + e.file_id).digest()
    for i in range(20):
        value = rc4(_turned(key, i), value)
    return value


def _owner_key(password: bytes, e: Encryption) -> bytes:
    key = hashlib.md5(padded(password)).digest()
    for _ in range(50 if e.revision > 2 else 0):
        key = hashlib.md5(key).digest()
    return key[: 5 if e.revision == 2 else e.key_bytes]


def early_owner(owner: bytes, user: bytes, e: Encryption) -> bytes:
    """The owner entry that hides a user password behind an owner password."""
    key, value = _owner_key(owner, e), padded(user)
    for i in range(20 if e.revision > 2 else 1):
        value = rc4(_turned(key, i), value)
    return value


def user_of_owner(owner: bytes, e: Encryption) -> bytes:
    key, value = _owner_key(owner, e), e.owner[:32]
    for i in reversed(range(20 if e.revision > 2 else 1)):
        value = rc4(_turned(key, i), value)
    return value


def hardened(password: bytes, salt: bytes, extra: bytes = b"") -> bytes:
    """The hash of revision 6: rounds of AES over the password until the last byte allows an end."""
    k, n = hashlib.sha256(password + salt + extra).digest(), 0
    while True:
        e = cbc_encrypt(k[:16], k[16:32], (password + k + extra) * 64, pad=False)
        k = (hashlib.sha256, hashlib.sha384, hashlib.sha512)[sum(e[:16]) % 3](e).digest()
        n += 1
        if n >= 64 and e[-1] <= n - 32:
            return k[:32]


def file_key(password: bytes, e: Encryption) -> bytes:
    """The key of a file for a user or owner password."""
    if e.revision < 5:
        for attempt in (password, user_of_owner(password, e)):
            key = early_key(attempt, e)
            size = 32 if e.revision == 2 else 16
            if early_user(key, e)[:size] == e.user[:size]:
                return key
        raise WrongPassword
    digest = hardened if e.revision == 6 else lambda p, salt, extra=b"": hashlib.sha256(p + salt + extra).digest()
    password = password[:127]
    if digest(password, e.owner[32:40], e.user[:48]) == e.owner[:32]:
        return cbc_decrypt(digest(password, e.owner[40:48], e.user[:48]), bytes(16), e.owner_key, pad=False)
    if digest(password, e.user[32:40]) == e.user[:32]:
        return cbc_decrypt(digest(password, e.user[40:48]), bytes(16), e.user_key, pad=False)
    raise WrongPassword


def object_key(key: bytes, number: int, generation: int, aes: bool) -> bytes:
    """The key of one object in revisions up to 4."""
    mixed = key + number.to_bytes(3, "little") + generation.to_bytes(2, "little") + (b"sAlT" if aes else b"")
    return hashlib.md5(mixed).digest()[: min(16, len(key) + 5)]
