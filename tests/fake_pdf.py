def blocks(data: bytes):
    for i, word in enumerate(data.decode().split()):
        yield {"page_number": 1, "block_index": i, "x0": 0, "y0": i, "x1": 1, "y1": i + 1, "text": word}
