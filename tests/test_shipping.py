from wayfare.shipping import ship


def test_ship_is_idempotent(spark):
    ship(spark)
    ship(spark)
