"""DataFrame operators: blocks, key/value pairs, images, answers, validation."""
