"""Operations for training-data pipelines over ``documents`` and ``pages``; nothing outside this package imports it."""
