"""Operations for building training data: one module for each operator, their queries in ``queries``."""
