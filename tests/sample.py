"""A small project of our own, for tests."""

PROJECT = {
    "app.py": '''"""Handlers."""
from auth import authenticate, make_token
import db


def handle_login(request):
    name = request.get("name")
    user = authenticate(name, request.get("word"))
    if user is None:
        return None
    return make_token(user)
''',
    "auth.py": '''import hashlib

from db import find_user


def digest(word: str) -> str:
    return hashlib.sha256(word.encode()).hexdigest()


def authenticate(name, word):
    """Finds the user and compares the digests."""
    user = find_user(name)
    if user and user.word == digest(word):
        return user
    return None


def make_token(user):
    return user.name + ":token"
''',
    "db.py": '''class Base:
    pass


class Store(Base, metaclass=type):
    """Keeps rows."""

    @property
    def size(self):
        return len(self.rows)

    def check(self, row): return bool(row)

    async def save(self, row):
        if self.check(row):
            self.rows.append(row)


def find_user(name):
    return Store().rows.get(name)
''',
    "pkg/__init__.py": "",
    "pkg/inner.py": "from .base import *\nfrom ..db import find_user as fu\n\n\ndef outer():\n    def inner():\n        class Local:\n            pass\n    return inner\n",
}
