"""A site for the listing tests: links by group and page in a folder, which also keeps who asked for what."""

import os
import uuid

from pyspark import TaskContext


class Site:
    def __init__(self, options):
        self.root, self.opened = options["root"], uuid.uuid4().hex

    def pages(self, group):
        path = f"{self.root}/{group}"
        return len(os.listdir(path)) if os.path.isdir(path) else 0

    def links(self, group, page):
        where = "driver" if TaskContext.get() is None else "executor"
        tries = f"{self.root}-log/{group}-{page}-{where}"
        os.makedirs(f"{self.root}-log", exist_ok=True)
        first = not os.path.exists(tries)
        with open(tries, "a") as f:
            f.write("x")
        if first and page == 2:
            raise ConnectionError("once")
        with open(f"{self.root}/{group}/{page}") as f:
            return f.read().split()
