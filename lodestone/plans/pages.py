"""A page fetcher that needs no network, for trying the paged source."""

import json


def numbers(page: int, per_page: int = 10, total: int = 25) -> list[str]:
    first = (page - 1) * per_page
    return [json.dumps({"number": n}) for n in range(first + 1, min(total, first + per_page) + 1)]
