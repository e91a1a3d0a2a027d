"""A client over recorded results, for the tests of the remote source; imported by name in the tasks."""

RESULTS = [{"title": f"T{k}" if k % 5 else "", "url": f"http://x/{k}", "snippet": "" if k % 4 == 0 else f"about {k}", "score": None if k % 3 == 0 else k / 10, "authors": ["A", k], "year": 2000 + k % 4, "metadata": {"source_id": "given" if k == 2 else "", "n": k, "none": None}} for k in range(23)]


class Client:
    def __init__(self, options):
        self.options = options

    def search(self, query, offset, limit, year=None):
        if query == "broken":
            raise RuntimeError("no answer")
        rows = [r for r in RESULTS if year is None or r["year"] == year]
        return rows[offset : offset + limit]


def client(options):
    return Client(options)
