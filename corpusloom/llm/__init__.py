"""Operations of training-data pipelines over documents and conversations."""
