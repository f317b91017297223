"""The formula catalogue, one formula in a line."""

# Id | template | variables (i integer, n number, r ratio; >= is the least value allowed) |
# constraints | decimal places of the result.
FORMULAS = """
F-01 | damaged_fruits / (damaged_fruits + normal_fruits) | damaged_fruits:i>=0 normal_fruits:i>=0 | damaged_fruits >= 0 | 4
F-02 | defoliated / (defoliated + attached) | defoliated:i>=0 attached:i>=0 |  | 4
F-03 | ceil(total_sample * (variety_target / total_target)) | total_sample:i>=1 variety_target:i>=0 total_target:i>=1 | total_target > 0 | 0
F-04 | (sample_fruits_sum / sample_trees_sum) * target_trees | sample_fruits_sum:i>=0 sample_trees_sum:i>=1 target_trees:i>=1 | sample_trees_sum > 0 | 0
F-05 | flooded_trees * (flooded_fruits / total_fruits) | flooded_trees:i>=0 flooded_fruits:i>=0 total_fruits:i>=1 | total_fruits > 0 | 0
F-06 | max(1.0115 * defoliation_rate - 0.0014 * elapsed_days, 0) | defoliation_rate:r elapsed_days:i>=0 | defoliation_rate in [0,1] | 4
F-07 | max(0.9662 * defoliation_rate - 0.0703, 0) | defoliation_rate:r | defoliation_rate in [0,1] | 4
F-08 | max(fruit_reduction - uncompensated - self_bearing, 0) * price * coverage | fruit_reduction:n>=0 uncompensated:n>=0 self_bearing:n>=0 price:n>=0 coverage:r |  | 0
F-09 | max(accumulated_reduction - self_bearing, 0) * price | accumulated_reduction:n>=0 self_bearing:n>=0 price:n>=0 |  | 0
F-10 | damaged_trees / actual_bearing_trees | damaged_trees:i>=0 actual_bearing_trees:i>=1 | actual_bearing_trees > 0 | 4
F-11 | insured_amount * max(damage_rate - 0.05, 0) | insured_amount:n>=0 damage_rate:r | damage_rate in [0,1] | 0
F-12 | 0.0031 * remaining_days | remaining_days:i>=0 |  | 4
F-13 | max(sunburn_fruits - fruits_after_thinning * 0.06, 0) | sunburn_fruits:i>=0 fruits_after_thinning:i>=0 |  | 0
F-14 | insured_amount * max(damage_rate - deductible_rate, 0) | insured_amount:n>=0 damage_rate:r deductible_rate:r | damage_rate in [0,1]; deductible_rate in [0,1] | 0
F-15 | max((standard_yield - actual_yield - uncompensated_loss) / standard_yield, 0) | standard_yield:n>=1 actual_yield:n>=0 uncompensated_loss:n>=0 | standard_yield > 0 | 4
F-16 | max(standard_yield - actual_yield, 0) * uncompensated_rate | standard_yield:n>=0 actual_yield:n>=0 uncompensated_rate:r | uncompensated_rate in [0,1] | 2
F-17 | max((standard_yield - actual_yield - uncompensated_loss - disease_loss) / standard_yield, 0) | standard_yield:n>=1 actual_yield:n>=0 uncompensated_loss:n>=0 disease_loss:n>=0 | standard_yield > 0 | 4
F-18 | insured_amount * damage_rate * 0.10 | insured_amount:n>=0 damage_rate:r | damage_rate in [0,1] | 0
F-19 | min(max(damage_amount - deductible, 0), insured_amount) | damage_amount:n>=0 deductible:n>=0 insured_amount:n>=0 |  | 0
F-20 | count_30 * 0.3 + count_50 * 0.5 + count_80 * 0.8 + count_100 * 1.0 | count_30:i>=0 count_50:i>=0 count_80:i>=0 count_100:i>=0 |  | 1
F-21 | grade_in_damaged + grade_out_damaged * 0.5 | grade_in_damaged:n>=0 grade_out_damaged:n>=0 |  | 1
F-22 | (damaged_fruit_count / base_fruit_count) * (1 - uncompensated_rate) | damaged_fruit_count:n>=0 base_fruit_count:i>=1 uncompensated_rate:r | base_fruit_count > 0; uncompensated_rate in [0,1] | 4
F-23 | (frost_80_count * 0.8 + frost_100_count * 1.0) / base_fruit_count | frost_80_count:i>=0 frost_100_count:i>=0 base_fruit_count:i>=1 | base_fruit_count > 0 | 4
F-24 | max((61 - 0.935 * day_of_month) / 100, 0) | day_of_month:i>=1 | day_of_month in [1,31] | 4
F-25 | max((32 - 0.774 * day_of_month) / 100, 0) | day_of_month:i>=1 | day_of_month in [1,31] | 4
F-26 | max((8 - 0.286 * day_of_month) / 100, 0) | day_of_month:i>=1 | day_of_month in [1,29] | 4
F-27 | (damaged_buds / total_buds) * (1 - uncompensated_rate) | damaged_buds:i>=0 total_buds:i>=1 uncompensated_rate:r | total_buds > 0; uncompensated_rate in [0,1] | 4
F-28 | max(1 - (days_since_harvest / standard_harvest_days), 0) | days_since_harvest:i>=0 standard_harvest_days:i>=1 | standard_harvest_days > 0 | 4
F-29 | bud_death_rate + (1 - bud_death_rate) * flower_death_rate | bud_death_rate:r flower_death_rate:r | bud_death_rate in [0,1]; flower_death_rate in [0,1] | 4
F-30 | max((100 - 1.06 * day_of_month) / 100, 0) | day_of_month:i>=1 | day_of_month in [1,31] | 4
F-31 | insured_amount * 0.15 | insured_amount:n>=0 |  | 0
F-32 | insured_amount * 0.25 * area_damage_rate | insured_amount:n>=0 area_damage_rate:r | area_damage_rate in [0,1] | 0
F-33 | damaged_area / insured_area | damaged_area:n>=0 insured_area:n>=1 | insured_area > 0 | 4
F-34 | insured_amount * max(damage_rate - deductible_rate, 0) | insured_amount:n>=0 damage_rate:r deductible_rate:r | damage_rate in [0,1]; deductible_rate in [0,1] | 0
F-35 | insured_amount * coverage_rate * elapsed_rate | insured_amount:n>=0 coverage_rate:r elapsed_rate:r | coverage_rate in [0,1]; elapsed_rate in [0,1] | 0
F-36 | min(max(((standard_yield - actual_yield - uncompensated_loss) + disease_loss) / standard_yield, 0), 1) | standard_yield:n>=1 actual_yield:n>=0 uncompensated_loss:n>=0 disease_loss:n>=0 | standard_yield > 0 | 4
F-37 | max(min(insured_amount, damage_yield * price) - insured_amount * deductible_rate, 0) | insured_amount:n>=0 damage_yield:n>=0 price:n>=0 deductible_rate:r | deductible_rate in [0,1] | 0
F-38 | max((1 - actual_yield / standard_yield) * (damaged_area / cultivated_area), 0) | actual_yield:n>=0 standard_yield:n damaged_area:n>=0 cultivated_area:n>=1 | standard_yield > 0; cultivated_area > 0 | 4
F-39 | insured_amount * 0.35 * standard_damage_rate | insured_amount:n>=0 standard_damage_rate:r | standard_damage_rate in [0,1] | 0
F-40 | max((30000 - plant_count) / 30000, 0) | plant_count:i>=0 |  | 4
F-41 | insured_amount * rate * area_damage_rate | insured_amount:n>=0 rate:r area_damage_rate:r | rate in [0,1]; area_damage_rate in [0,1] | 0
F-42 | insured_amount * 0.20 * area_damage_rate | insured_amount:n>=0 area_damage_rate:r | area_damage_rate in [0,1] | 0
F-43 | insured_amount * max(damage_rate - deductible_rate, 0) | insured_amount:n>=0 damage_rate:r deductible_rate:r | damage_rate in [0,1]; deductible_rate in [0,1] | 0
F-44 | alpha + (1 - alpha) * min(growth_days / standard_growth_days, 1) | alpha:r growth_days:i>=0 standard_growth_days:i>=1 | alpha in [0,1]; standard_growth_days > 0 | 4
F-45 | max(1 - harvest_days / standard_harvest_days, 0) | harvest_days:i>=0 standard_harvest_days:i>=1 | standard_harvest_days > 0 | 4
F-46 | area_damage_rate * avg_loss_ratio * (1 - uncompensated_rate) | area_damage_rate:r avg_loss_ratio:r uncompensated_rate:r | area_damage_rate in [0,1]; avg_loss_ratio in [0,1]; uncompensated_rate in [0,1] | 4
F-47 | cultivated_area * unit_cost * elapsed_rate * damage_rate | cultivated_area:n>=0 unit_cost:n>=0 elapsed_rate:r damage_rate:r | elapsed_rate in [0,1]; damage_rate in [0,1] | 0
F-48 | base_insurance * insured_amount / (unit_cost * cultivated_area) | base_insurance:n>=0 insured_amount:n>=0 unit_cost:n>=1 cultivated_area:n>=1 | cultivated_area > 0; unit_cost > 0 | 0
F-49 | area_damage_rate * (1 - uncompensated_rate) | area_damage_rate:r uncompensated_rate:r | area_damage_rate in [0,1]; uncompensated_rate in [0,1] | 4
F-50 | lodging_area * 0.70 + non_lodging_area * avg_loss_ratio | lodging_area:n>=0 non_lodging_area:n>=0 avg_loss_ratio:r | avg_loss_ratio in [0,1] | 2
F-51 | area_damage_rate * crop_damage_rate * (1 - uncompensated_rate) | area_damage_rate:r crop_damage_rate:r uncompensated_rate:r | area_damage_rate in [0,1]; crop_damage_rate in [0,1]; uncompensated_rate in [0,1] | 4
F-52 | max(remaining_insured * elapsed_rate * damage_rate * disease_recognition_rate - remaining_insured * deductible_rate, 0) | remaining_insured:n>=0 elapsed_rate:r damage_rate:r disease_recognition_rate:r deductible_rate:r | elapsed_rate in [0,1]; damage_rate in [0,1]; disease_recognition_rate in [0,1]; deductible_rate in [0,1] | 0
F-53 | max((67 - 1.13 * day_of_month) / 100, 0) | day_of_month:i>=1 | day_of_month in [1,30] | 4
F-54 | max(damage_amount - deductible, 0) | damage_amount:n>=0 deductible:n>=0 |  | 0
F-55 | min(max(damage_amount * 0.10, min_deductible), max_deductible) | damage_amount:n>=0 min_deductible:n>=0 max_deductible:n>=0 | min_deductible >= 0; max_deductible >= 0 | 0
F-56 | cultivated_area * unit_cost * elapsed_rate * damage_rate | cultivated_area:n>=0 unit_cost:n>=0 elapsed_rate:r damage_rate:r | elapsed_rate in [0,1]; damage_rate in [0,1] | 0
F-57 | alpha + (1 - alpha) * min(growth_days / standard_growth_days, 1) | alpha:r growth_days:i>=0 standard_growth_days:i>=1 | alpha in [0,1]; standard_growth_days > 0 | 4
F-58 | max(1 - harvest_days / standard_harvest_days, 0) | harvest_days:i>=0 standard_harvest_days:i>=1 | standard_harvest_days > 0 | 4
F-59 | damage_area_rate * loss_degree_rate * (1 - uncompensated_rate) | damage_area_rate:r loss_degree_rate:r uncompensated_rate:r | damage_area_rate in [0,1]; loss_degree_rate in [0,1]; uncompensated_rate in [0,1] | 4
F-60 | cultivated_area * unit_cost_alive * damage_rate | cultivated_area:n>=0 unit_cost_alive:n>=0 damage_rate:r | damage_rate in [0,1] | 0
F-61 | cultivated_area * unit_cost * damage_rate * 0.70 | cultivated_area:n>=0 unit_cost:n>=0 damage_rate:r | damage_rate in [0,1] | 0
F-62 | log_count * unit_cost_per_log * damage_rate | log_count:i>=0 unit_cost_per_log:n>=0 damage_rate:r | damage_rate in [0,1] | 0
F-63 | bag_count * unit_cost_per_bag * elapsed_rate * damage_rate | bag_count:i>=0 unit_cost_per_bag:n>=0 elapsed_rate:r damage_rate:r | elapsed_rate in [0,1]; damage_rate in [0,1] | 0
F-64 | original_value * min(0.08 * elapsed_years, 1) | original_value:n>=0 elapsed_years:n>=0 |  | 0
F-65 | original_value * min(0.053 * elapsed_years, 1) | original_value:n>=0 elapsed_years:n>=0 |  | 0
F-66 | max(original_value - depreciation, 0) | original_value:n>=0 depreciation:n>=0 |  | 0
F-67 | max(damage_amount - deductible, 0) * (insured_amount / insured_value) | damage_amount:n>=0 deductible:n>=0 insured_amount:n>=0 insured_value:n>=1 | insured_value > 0 | 0
F-68 | max((33 - 0.84 * day_of_month) / 100, 0) | day_of_month:i>=1 | day_of_month in [1,31] | 4
"""
