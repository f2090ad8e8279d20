"""Extractors of the tests; each tells a file what happens to it."""

import os
import time

from quire.sources.extract import ExtractionError, FakeExtractor


def told(folder, what):
    with open(os.path.join(folder, "told"), "a") as f:
        f.write(f"{what} {os.getpid()}\n")


class Telling(FakeExtractor):
    """Made with a folder; opens its files itself."""

    opens_files, method = True, "telling"

    def __init__(self, folder):
        self.folder = folder
        told(folder, "made")

    def pages(self, path, content):
        assert content is None
        return super().pages(path, self._read(path))

    def native(self, path, content, page):
        return super().native(path, self._read(path), page)

    def text(self, path, content, page, layout):
        told(self.folder, "began")
        print("noise on standard output")
        out = super().text(path, content, page, layout)
        if "SLOW" in out:
            time.sleep(0.4)
        told(self.folder, "ended")
        return out

    def _read(self, path):
        with open(path.removeprefix("file:"), "rb") as f:
            return f.read()


def unmakeable():
    raise ExtractionError("the model isn't there")
