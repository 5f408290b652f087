"""Column functions: text, JSON and image-response shaping."""
